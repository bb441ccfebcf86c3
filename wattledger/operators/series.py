"""Reading series: wide-to-long reshaping, the per-account array, representative averages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattledger.functions import arrays as A
from wattledger.functions.classify import catalogue_key
from wattledger.functions.parse import locale_number
from wattledger.params import PLAUSIBLE_KWH, Averaging, Segmentation


def month_axis(last: date, n: int, oldest_first: bool = True) -> list[date]:
    """First days of the ``n`` months that end in ``last``, in column order."""
    end = last.year * 12 + last.month - 1
    months = [date(m // 12, m % 12 + 1, 1) for m in range(end - n + 1, end + 1)]
    return months if oldest_first else months[::-1]


def reading_columns(columns: Sequence[str], prefix: str = "KWH_") -> list[str]:
    """Columns ``KWH_1 … KWH_n`` by their number, not by their text."""
    found = [c for c in columns if c.startswith(prefix) and c[len(prefix):].isdigit()]
    if not found:
        raise ValueError(f"no column starts with {prefix!r}")
    return sorted(found, key=lambda c: int(c[len(prefix):]))


def unpivot_readings(
    wide: DataFrame, account: str, last: date, *, prefix: str = "KWH_", oldest_first: bool = True
) -> DataFrame:
    """Wide text columns to ``(account, period, kwh)``; one narrow generate, no shuffle."""
    cols = reading_columns(wide.columns, prefix)
    axis = month_axis(last, len(cols), oldest_first)
    pairs = F.array(*[
        F.struct(F.lit(m).alias("period"), locale_number(F.col(c)).alias("kwh")) for m, c in zip(axis, cols)
    ])
    return wide.select(F.col(account).alias("account"), F.inline(pairs))


def flag_readings(long: DataFrame) -> DataFrame:
    """Zero and negative flags; a negative reading becomes NULL, a NULL is not a zero."""
    negative = F.coalesce(F.col("kwh") < 0, F.lit(False))
    return long.select(
        *[c for c in long.columns if c != "kwh"],
        F.when(~negative, F.col("kwh")).alias("kwh"),
        F.coalesce(F.col("kwh") == 0, F.lit(False)).alias("is_zero"),
        negative.alias("is_negative"),
    )


def first_per_account(df: DataFrame, order: Sequence[Column], account: str = "account") -> DataFrame:
    """One row per account, the first by ``order`` (use a full tie-break).

    ``min_by`` over a struct keeps map-side combining, so a heavily repeated
    account is reduced before the shuffle.
    """
    payload = F.struct(*[F.col(c) for c in df.columns if c != account])
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(account).agg(F.min_by(payload, key).alias("__first")).select(account, "__first.*")


def orientation(wide: DataFrame, newest: str, oldest: str, reported: str, min_rows: int = 30) -> DataFrame:
    """Does the newest column follow the reported last month better than the oldest?"""
    usable = wide.where(
        F.col(newest).isNotNull() & F.col(oldest).isNotNull() & (F.col(reported) > 0)
    )
    def corr(col: str) -> Column:
        c = F.corr(col, reported)
        return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(c)
    stats = usable.agg(
        F.count(F.lit(1)).alias("n_rows"), corr(newest).alias("corr_newest"), corr(oldest).alias("corr_oldest")
    )
    ok = (F.col("n_rows") < min_rows) | (F.col("corr_newest") + 1e-9 >= F.col("corr_oldest"))
    return stats.withColumn("oriented", ok)


def assert_oriented(check: DataFrame) -> None:
    """Abort the load when the axis is inverted; reads the single row of the check."""
    row = check.first()
    if row is not None and not row["oriented"]:
        raise ValueError(
            f"month order looks inverted: newest {row['corr_newest']:.3f} < oldest {row['corr_oldest']:.3f}"
        )


def plausible_range(averages: DataFrame, tariff: str = "tariff", kwh: str = "mean_kwh") -> DataFrame:
    """Share of customers whose mean lies outside the plausible range of their class."""
    limits = F.create_map(*[
        x for k, (lo, hi) in PLAUSIBLE_KWH.items()
        for x in (F.lit(k), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))
    ])
    keyed = averages.withColumn("class_key", catalogue_key(F.col(tariff), list(PLAUSIBLE_KWH))).withColumn(
        "__r", F.element_at(limits, F.col("class_key")))
    # Missing means and unknown texts are left out by the aggregates: a filter would be worked out twice, and in the scan.
    outside = (F.col(kwh) < F.col("__r.lo")) | (F.col(kwh) > F.col("__r.hi"))
    return keyed.groupBy("class_key").agg(
        F.count(F.when(F.col("class_key").isNotNull(), F.col(kwh))).alias("customers"),
        (F.avg(outside.cast("double")) * 100).alias("pct_outside"),
    ).where(F.col("customers") > 0).withColumn("warning", F.col("pct_outside") > 5.0)


def enrich_register(register: DataFrame, aux: DataFrame) -> DataFrame:
    """Service state, phases and previous P/Q from the auxiliary table.

    A missing state counts as active, unreadable phases as one.
    """
    extra = aux.select(
        "account", F.col("state").alias("__s"), F.col("phases_text").alias("__p"), "p_prev_kw", "q_prev_kvar"
    )
    return register.join(extra, "account", "left").withColumns({
        "active": F.coalesce(F.upper(F.trim("__s")) == "ACT", F.lit(True)),
        "phases": F.coalesce(F.col("__p").try_cast("int"), F.lit(1)),
    }).drop("__s", "__p")


def account_series(long: DataFrame, last: date, months: int) -> DataFrame:
    """``(account, series)``: kWh per month of the axis, oldest first, NULL where missing.

    Every month of the axis is a maximum of its own, so an account's readings are combined on the map side to one row of
    at most ``months`` values whatever the number of raw rows it has.
    """
    first = month_axis(last, months)[0]
    index = (F.year("period") * 12 + F.month("period") - F.lit(first.year * 12 + first.month)).cast("int")
    placed = long.where(F.col("period").between(F.lit(first), F.last_day(F.lit(last)))).select("account", index.alias("i"), "kwh")
    packed = placed.groupBy("account").agg(*[F.max(F.when(F.col("i") == i, F.col("kwh"))).alias(f"__m{i}") for i in range(months)])
    return packed.select("account", F.array(*[F.col(f"__m{i}") for i in range(months)]).alias("series"))


def with_all_accounts(register: DataFrame, series: DataFrame, months: int) -> DataFrame:
    """Register rows with their ``series``; an account that was never read has an array of missing months.

    The join is a shuffled one at any size: what is worked out of the series afterwards runs in its tasks, and a register
    in a few compressed files would be a few tasks.
    """
    unread = F.array_repeat(F.lit(None).cast("double"), months)
    return register.join(series.hint("merge"), "account", "left").withColumn("series", F.coalesce("series", unread))


def series_statistics(df: DataFrame, p: Segmentation = Segmentation()) -> DataFrame:
    """Finite values, mean of all months and own base level (P75) per account."""
    return (
        df.withColumn("finite", F.expr("filter(series, x -> x is not null and not isnan(x))"))
        .withColumn("mean_kwh", F.expr(A.mean("finite")))
        .withColumn("__s", F.sort_array("finite"))
        .withColumn("base_kwh", F.expr(A.quantile_sorted("__s", p.base_percentile)))
        .drop("__s")
    )


def representative_average(
    df: DataFrame, p: Averaging = Averaging(), *, first_month: int = 1
) -> DataFrame:
    """Add ``avg_kwh``, ``n_valid``, ``cv`` and ``reliable`` from the last months of ``series``.

    Optional inputs: ``suspended`` (boolean) and ``estimated`` (array aligned with
    ``series``). ``first_month`` is the calendar month of the first array entry,
    used by the seasonal method only.
    """
    size, w = "size(series)", p.window
    start = f"greatest({size} - {w} + 1, 1)"
    keep = "e.x is not null"
    if p.drop_suspended_zeros and "suspended" in df.columns:
        keep += " and (not coalesce(suspended, false) or e.x > 0)"
    if p.drop_estimated and "estimated" in df.columns:
        keep += " and not coalesce(get(estimated, e.i), false)"
    # i is the position in the whole series: age and calendar month come from it.
    entries = f"filter(transform(slice(series, {start}, {w}), (x, j) -> struct(x, j + {start} - 1 as i)), e -> {keep})"
    out = (
        df.withColumn("__e", F.expr(entries))
        .withColumn("__v", F.expr("transform(__e, e -> e.x)"))
        .withColumn("n_valid", F.size("__v"))
        .withColumn("__m", F.expr(A.mean("__v")))
    )
    out = out.withColumn("cv", F.expr(f"if(__m > 0, {A.std_pop('__v', '__m')} / __m, null)"))
    if p.method == "mean":
        rep = "__m"
    elif p.method == "recency":
        weight = f"pow(0.5D, ({size} - 1 - e.i) / {max(p.half_life, 1e-9)!r}D)"
        rep = (
            f"aggregate(__e, 0D, (acc, e) -> acc + e.x * {weight}) / "
            f"nullif(aggregate(__e, 0D, (acc, e) -> acc + {weight}), 0D)"
        )
    elif p.method == "seasonal":
        by_month = (
            "filter(transform(sequence(0, 11), k -> transform(filter(__e, "
            f"e -> (e.i + {first_month - 1}) % 12 = k), e -> e.x)), a -> size(a) > 0)"
        )
        out = out.withColumn("__months", F.expr(f"transform({by_month}, a -> {A.mean('a')})"))
        rep = A.mean("__months")
    else:
        out = out.withColumn("__o", F.sort_array("__v"))
        if p.method == "median":
            rep = A.median_sorted("__o")
        else:
            out = out.withColumn("__k", F.expr(f"cast(floor(n_valid * {p.trim_pct / 100.0!r}D) as int)"))
            inner = "slice(__o, __k + 1, greatest(n_valid - 2 * __k, 0))"
            rep = f"if(2 * __k >= n_valid, {A.median_sorted('__o')}, {A.mean(inner)})"
    return out.withColumn("avg_kwh", F.expr(f"if(n_valid = 0, 0D, {rep})")).withColumn(
        "reliable", F.col("n_valid") >= p.min_valid
    ).drop("__e", "__v", "__m", "__o", "__k", "__months")
