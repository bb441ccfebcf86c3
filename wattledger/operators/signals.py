"""Behavioural signals in [0, 1] per customer, and the three network signals.

S1, S3, S4 and S7 read one customer's array and are projections. S5 and S8
compare with a group: the group statistics are aggregates joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions import arrays as A
from wattledger.operators.ranking import attach, exact_percentiles_of
from wattledger.params import SIGNALS, Signals


def drop_and_recovery(df: DataFrame, p: Signals = Signals()) -> DataFrame:
    """S1: the first longest run below the own base, followed by a recovery."""
    low = f"s1_base * {1 - p.s1_drop_pct / 100.0!r}D"
    back = f"s1_base * {1 - p.s1_recovery_pct / 100.0!r}D"
    run = (
        "aggregate(finite, named_struct('i', 0, 'run', 0, 'best', 0, 'at', -1), (a, x) -> "
        f"if(x < {low}, if(a.run + 1 > a.best, "
        "named_struct('i', a.i + 1, 'run', a.run + 1, 'best', a.run + 1, 'at', a.i), "
        "named_struct('i', a.i + 1, 'run', a.run + 1, 'best', a.best, 'at', a.at)), "
        "named_struct('i', a.i + 1, 'run', 0, 'best', a.best, 'at', a.at)))"
    )
    head = "sort_array(slice(finite, 1, greatest(3, cast(size(finite) div 4 as int))))"
    hit = (
        f"size(finite) >= {p.s1_min_months * 2 + 2} and s1_base > 0 and __run.best >= {p.s1_min_months} "
        f"and exists(slice(finite, __run.at + 2, greatest(size(finite), 1)), x -> x >= {back})"
    )
    return (
        df.withColumn("__head", F.expr(head))
        .withColumn("s1_base", F.expr(A.median_sorted("__head")))
        .withColumn("__run", F.expr(run))
        .withColumn("s1_months", F.expr("__run.best"))
        .withColumn("S1", F.expr(f"if({hit}, least(1D, __run.best / {float(p.s1_min_months)!r}D * 0.6D), 0D)"))
        .drop("__head", "__run")
    )


def level_break(df: DataFrame, p: Signals = Signals()) -> DataFrame:
    """S3: best single split by relative change of the mean, kept only if it fell.

    One pass with a running sum: the largest change of either sign wins, the
    first one on a tie, and only then is it asked whether it was a drop.
    """
    m1, m2 = "(a.s / a.i)", "((__t - a.s) / (__n - a.i))"
    delta = f"(abs({m2} - {m1}) / greatest({m1}, 1e-6D))"
    inside = "a.i >= 3 and a.i < __n - 3"
    # The change is worked out once a month, the rest of the split only where it is the best so far.
    better = f"if({inside}, {delta} > a.b.d, false)"
    split = f"named_struct('d', {delta}, 'at', a.i, 'm1', {m1}, 'm2', {m2})"
    step = (
        "aggregate(finite, named_struct('i', 0, 's', 0D, 'b', named_struct('d', 0D, 'at', -1, 'm1', 0D, 'm2', 0D)), "
        f"(a, x) -> named_struct('i', a.i + 1, 's', a.s + x, 'b', if({better}, {split}, a.b)), a -> a.b)"
    )
    hit = f"__n >= 8 and __b.d * 100 >= {p.s3_change_pct!r}D and __b.m2 < __b.m1"
    return (
        df.withColumn("__t", F.expr(A.total("finite")))
        .withColumn("__n", F.size("finite"))
        .withColumn("__b", F.expr(step))
        .withColumns({"s3_at": F.expr("__b.at"), "s3_before": F.expr("__b.m1"), "s3_after": F.expr("__b.m2")})
        .withColumn("S3", F.expr(f"if({hit}, least(1D, __b.d), 0D)"))
        .drop("__t", "__n", "__b")
    )


def zero_run(df: DataFrame, p: Signals = Signals()) -> DataFrame:
    """S4: longest run of zero months while the service is active; NULL breaks a run."""
    run = (
        "aggregate(series, named_struct('run', 0, 'best', 0), (a, x) -> named_struct("
        "'run', if(coalesce(x, -1D) = 0, a.run + 1, 0), "
        "'best', if(coalesce(x, -1D) = 0, greatest(a.best, a.run + 1), a.best))).best"
    )
    active = F.coalesce(F.col("active"), F.lit(True)) if "active" in df.columns else F.lit(True)
    return df.withColumn("s4_months", F.expr(run)).withColumn(
        "S4",
        F.when(
            active & (F.col("s4_months") >= p.s4_min_zeros),
            F.least(F.lit(1.0), F.col("s4_months") / F.lit(p.s4_min_zeros * 2.0)),
        ).otherwise(F.lit(0.0)),
    )


def flatness(df: DataFrame, p: Signals = Signals()) -> DataFrame:
    """S7: nearly constant positive consumption."""
    return (
        df.withColumn("__p", F.expr("filter(finite, x -> x > 0)"))
        .withColumn("__m", F.expr(A.mean("__p")))
        .withColumn("s7_cv", F.expr(f"if(size(__p) >= 6, {A.std_pop('__p', '__m')} / nullif(__m, 0D), null)"))
        .withColumn(
            "S7",
            F.when(F.col("s7_cv") < p.s7_cv_max, F.least(F.lit(1.0), 1 - F.col("s7_cv") / F.lit(max(p.s7_cv_max, 1e-9))))
            .otherwise(F.lit(0.0)),
        )
        .drop("__p", "__m")
    )


def below_peers(df: DataFrame, p: Signals = Signals(), group: str = "peer_group") -> DataFrame:
    """S5: below the low percentile of its peer group, weighted by the group's confidence."""
    if "peer_p50" not in df.columns:
        df = attach(df, peer_statistics(df, p, group), [group])
    weight = F.least(F.greatest(F.coalesce(F.col("peer_confidence"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) \
        if "peer_confidence" in df.columns else F.lit(1.0)
    fires = (
        (F.col("n_mean_kwh") >= p.s5_min_peers) & (F.col("peer_p50") > 0) & (F.col("mean_kwh") < F.col("peer_p5"))
    )
    deficit = F.least(F.greatest(1 - F.col("mean_kwh") / F.nullif("peer_p50", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return df.withColumn("S5", F.when(fires, deficit * weight).otherwise(F.lit(0.0))).drop(
        "n_mean_kwh", "n_avg_kwh", "peer_p5", "peer_p50"
    )


def peer_statistics(df: DataFrame, p: Signals = Signals(), group: str = "peer_group") -> DataFrame:
    """Per peer group: low percentile and median of the mean, and the expected consumption.

    One distributed pass serves S5 and the recoverable energy.
    """
    wanted: dict[str, dict[str, float]] = {"mean_kwh": {"peer_p5": p.s5_percentile, "peer_p50": 0.5}}
    if "avg_kwh" in df.columns and "expected_kwh" not in df.columns:
        wanted["avg_kwh"] = {"expected_kwh": 0.5}
    return exact_percentiles_of(df.where(F.col(group).isNotNull()), [group], wanted)


def below_site(df: DataFrame, p: Signals = Signals(), site: str = "site") -> DataFrame:
    """S8: below the mean of a transformer site whose customers are widely spread."""
    known = df.where(F.col(site).isNotNull())
    stats = known.groupBy(site).agg(
        F.count(F.lit(1)).alias("__n"), F.avg("mean_kwh").alias("__m"), F.stddev_pop("mean_kwh").alias("__sd")
    )
    fires = (
        (F.col("__n") >= p.s8_min_units) & (F.col("__m") > 0)
        & (F.col("__sd") / F.nullif("__m", F.lit(0.0)) >= p.s8_cv_min) & (F.col("mean_kwh") < F.col("__m"))
    )
    deficit = F.least(F.greatest(1 - F.col("mean_kwh") / F.nullif("__m", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return attach(df, stats, [site]).withColumn("S8", F.when(fires, deficit).otherwise(F.lit(0.0))).drop(
        "__n", "__m", "__sd"
    )


def below_own_base(df: DataFrame, p: Signals = Signals()) -> DataFrame:
    """S9: mean consumption far below the own base level."""
    deficit = F.when(F.col("base_kwh") > 0, 1 - F.col("mean_kwh") / F.col("base_kwh")).otherwise(F.lit(0.0))
    return df.withColumn(
        "S9",
        F.when(deficit >= p.s9_min_deficit, F.least(deficit, F.lit(1.0))).otherwise(F.lit(0.0)),
    )


def own_history_signals(df: DataFrame, p: Signals = Signals()) -> DataFrame:
    """S1, S3, S4, S7 and S9 in one narrow projection."""
    for step in (drop_and_recovery, level_break, zero_run, flatness, below_own_base):
        df = step(df, p)
    return df


def signal_matrix(df: DataFrame, p: Signals = Signals()) -> DataFrame:
    """All seven signals. Needs series, finite, mean_kwh, base_kwh, peer_group and site."""
    # Group statistics first: they then read only the group and mean columns of ``df``.
    return own_history_signals(below_peers(below_site(df, p), p), p)


def evidence(df: DataFrame) -> DataFrame:
    """``(account, evidence)``: one record per active signal with its numbers as text."""
    def record(signal: str, **values: Column) -> Column:
        items = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
        return F.when(
            F.col(signal) > 0, F.struct(F.lit(signal).alias("signal"), F.create_map(*items).alias("facts"))
        )
    c = F.col
    records = F.array(
        record("S1", base=F.round("s1_base", 2), months=c("s1_months"), recovered=F.lit(True)),
        record("S3", split=c("s3_at"), before=F.round("s3_before", 2), after=F.round("s3_after", 2),
               change_pct=F.round(c("S3") * 100, 1)),
        record("S4", zero_months=c("s4_months"), active=F.lit(True)),
        record("S5", group_deficit=F.round("S5", 3), level=c("peer_level")),
        record("S7", cv=F.round("s7_cv", 4)),
        record("S8", site_deficit=F.round("S8", 3)),
        record("S9", own_base_deficit=F.round("S9", 3)),
    )
    return df.select("account", F.filter(records, lambda r: r.isNotNull()).alias("evidence"))


# --- network signals -------------------------------------------------------

def zone_residual(energy_in: Column, billed: Column, technical: Column) -> tuple[Column, Column]:
    """N1: residual energy of a zone and its share of the input, clipped to [0, 1]."""
    residual = energy_in - billed - technical
    share = F.when(
        energy_in > 0, F.least(F.greatest(residual / F.nullif(energy_in, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    ).otherwise(F.lit(0.0))
    return residual, share


def totaliser_balance(totaliser: Column, individuals: Column) -> tuple[Column, Column]:
    """N3: energy the totaliser saw and the individual meters did not."""
    return zone_residual(totaliser, individuals, F.lit(0.0))


def loading_incoherence(ratio: Column, threshold: float = 0.30) -> Column:
    """N4: how far the loading lies below the credible minimum."""
    return F.when(
        ratio < threshold, F.least(F.greatest((F.lit(threshold) - ratio) / threshold, F.lit(0.0)), F.lit(1.0))
    ).otherwise(F.lit(0.0))


ALL_SIGNALS = SIGNALS
