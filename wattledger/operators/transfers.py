"""Unreported load transfers between feeders, from head energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattledger.functions import arrays as A
from wattledger.operators.rangejoin import interval_join
from wattledger.operators.ranking import attach, exact_percentiles
from wattledger.staging import stage

MAD = 1.4826


def residuals(head: DataFrame, *, remove_common: bool = True) -> DataFrame:
    """``(feeder, period, i, kwh, prev, delta)``: monthly change with the common movement removed.

    ``i`` is the position on the axis of all periods. With fewer than three
    periods there is nothing to compare and the result is empty.
    """
    monthly = head.groupBy("feeder", "period").agg(F.sum("kwh").alias("kwh"))
    axis = monthly.select("period").distinct()
    # One row per period: the axis is a short list.
    axis = axis.select(
        "period",
        (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("period")) - 1).alias("i"),
        F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("__periods"),
    )
    placed = monthly.join(axis, "period").where(F.col("__periods") >= 3).drop("__periods")
    # A feeder has one row per period, so this window is bounded by the axis.
    w = Window.partitionBy("feeder").orderBy("i")
    lagged = stage(
        placed.withColumn("prev", F.when(F.lag("i").over(w) == F.col("i") - 1, F.lag("kwh").over(w)))
        .withColumn("rel", F.col("kwh") / F.nullif("prev", F.lit(0.0)) - 1), "head",
    )
    many = lagged.select("feeder").distinct().limit(3).count() >= 3
    if not (remove_common and many):
        return lagged.withColumn("delta", F.col("kwh") - F.col("prev")).drop("rel")
    common = exact_percentiles(lagged, ["i"], "rel", {"common": 0.5}).drop("n")
    return attach(lagged, common, ["i"]).withColumn(
        "delta", (F.col("rel") - F.col("common")) * F.col("prev")
    ).drop("rel", "common")


def _mad(array: str, median: str) -> str:
    return f"{MAD}D * {A.median_sorted(f'array_sort(transform({array}, x -> abs(x - {median})))')}"


def feeder_noise(res: DataFrame) -> DataFrame:
    """``(feeder, noise, kwhs)``: robust noise of the residuals and the series by position."""
    per = res.groupBy("feeder").agg(
        F.array_sort(F.collect_list("delta")).alias("__d"),          # one entry per period
        F.map_from_entries(F.collect_list(F.struct("i", "kwh"))).alias("__k"),
        F.max("i").alias("__last"),
    )
    return per.withColumn("__m", F.expr(A.median_sorted("__d"))).select(
        "feeder", F.expr(f"if(size(__d) < 3, 0D, {_mad('__d', '__m')})").alias("noise"),
        F.expr("transform(sequence(0, __last), k -> try_element_at(__k, k))").alias("kwhs"),
    )


def _step(before: str, after: str) -> Column:
    """Lasting rise of the ratio B/A: NULL without two points on each side."""
    return F.expr(
        f"if(size({before}) < 2 or size({after}) < 2, null, "
        f"if(__mb >= __ma, false, if(__sb + __sa > 0, __ma - __mb > 2D * (__sb + __sa), true)))"
    )


def transfer_candidates(
    res: DataFrame, *, neighbours: DataFrame | None = None, min_change_pct: float = 10.0, min_kwh: float = 0.0,
    min_symmetry: float = 0.60, require_sustained: bool = True,
) -> DataFrame:
    """Pairs where one feeder loses and another gains comparable energy in one period.

    ``res`` is a staged :func:`residuals` table. ``neighbours`` (feeder_a, feeder_b)
    turns the pairing into an equi-join. Without it, pairs are found by magnitude:
    whatever passes the symmetry or noise test has a gap no larger than the reach of
    one of the two, so an interval join on |delta| finds all of them without
    comparing every loser with every gainer.
    """
    noise = stage(feeder_noise(res), "noise")
    w = Window.partitionBy("feeder").orderBy("i")
    moves = (
        res.withColumn("next", F.when(F.lead("i").over(w) == F.col("i") + 1, F.lead("delta").over(w)))
        .join(noise.select("feeder", "noise"), "feeder")
        .where((F.col("prev") > 0) & F.col("delta").isNotNull() & (F.col("delta") != 0))
        .withColumn("mag", F.abs("delta"))
        .withColumn("pct", F.col("mag") / F.col("prev") * 100.0)
        .withColumn("reach", F.greatest(2.0 * F.col("noise"), F.col("mag") * (1.0 / min_symmetry - 1.0)) * (1 + 1e-9))
    )
    moves = stage(moves, "moves")
    cols = ["delta", "prev", "next", "noise", "mag", "pct", "reach"]
    side = lambda cond, tag: moves.where(cond).select(
        "period", "i", F.col("feeder").alias(f"feeder_{tag}"), *[F.col(c).alias(f"{c}_{tag}") for c in cols])
    lose, gain = side(F.col("delta") < 0, "a"), side(F.col("delta") > 0, "b")
    keys = ["period", "i"]
    if neighbours is not None:
        pairs = lose.join(neighbours.select("feeder_a", "feeder_b").distinct(), "feeder_a").join(gain, [*keys, "feeder_b"])
    else:
        around = lambda df, t: df.withColumns({
            f"lo_{t}": F.col(f"mag_{t}") - F.col(f"reach_{t}"), f"hi_{t}": F.col(f"mag_{t}") + F.col(f"reach_{t}")})
        by_a = interval_join(gain, around(lose, "a"), keys, "mag_b", "lo_a", "hi_a").drop("lo_a", "hi_a")
        by_b = interval_join(lose, around(gain, "b"), keys, "mag_a", "lo_b", "hi_b").drop("lo_b", "hi_b")
        seen = F.abs(F.col("mag_a") - F.col("mag_b")) <= F.col("reach_a")
        pairs = by_a.unionByName(by_b.where(~seen))
    small, large = F.least("mag_a", "mag_b"), F.greatest("mag_a", "mag_b")
    wa, wb = (1.0 / F.pow(F.greatest(F.col(f"noise_{t}"), F.lit(1.0)), F.lit(2.0)) for t in "ab")
    peak = F.greatest("pct_a", "pct_b")
    reverts = F.coalesce(
        (F.col("next_a") > 0) & (F.col("next_a") > 0.7 * F.col("mag_a"))
        & (F.col("next_b") < 0) & (-F.col("next_b") > 0.7 * F.col("mag_b")), F.lit(False))
    found = pairs.withColumns({
        "symmetry": small / large,
        "magnitude": (F.col("mag_a") * wa + F.col("mag_b") * wb) / (wa + wb),
        "sustained": ~reverts,
    }).where(
        (peak >= min_change_pct)
        & ((F.col("symmetry") >= min_symmetry) | (large - small <= 2.0 * F.greatest("noise_a", "noise_b")))
        & (F.col("magnitude") >= min_kwh)
    )
    if require_sustained:
        found = found.where("sustained")
    # The ratio test reads both feeders' series, each bounded by the period axis.
    maps = noise.select("feeder", "kwhs")
    tested = (
        found.join(maps.select(F.col("feeder").alias("feeder_a"), F.col("kwhs").alias("ka")), "feeder_a")
        .join(maps.select(F.col("feeder").alias("feeder_b"), F.col("kwhs").alias("kb")), "feeder_b")
        .withColumn("__r", F.expr("transform(ka, (v, k) -> get(kb, k) / nullif(v, 0D))"))
        .withColumn("__b", F.expr("array_sort(filter(slice(__r, 1, i), r -> r is not null))"))
        .withColumn("__a", F.expr("array_sort(filter(slice(__r, i + 1, size(__r)), r -> r is not null))"))
        .drop("__r", "ka", "kb")
    )
    # Staged, so that the filter below reads the sorted ratios instead of rebuilding
    # them inside its own expression.
    tested = (
        stage(tested, "ratios")
        .withColumn("__mb", F.expr(A.median_sorted("__b")))
        .withColumn("__ma", F.expr(A.median_sorted("__a")))
        .withColumn("__sb", F.expr(_mad("__b", "__mb")))
        .withColumn("__sa", F.expr(_mad("__a", "__ma")))
        .withColumn("__step", _step("__b", "__a"))
    )
    if require_sustained:
        tested = tested.where(F.coalesce(F.col("__step"), F.lit(True)))
    confidence = (
        0.5 * F.col("symmetry") + F.when(F.col("sustained"), 0.3).otherwise(0.0)
        + 0.2 * F.least(F.greatest("pct_a", "pct_b") / 100.0, F.lit(1.0))
    )
    return tested.select(
        "feeder_a", "feeder_b", "period", F.col("delta_a").alias("delta_a_kwh"), F.col("delta_b").alias("delta_b_kwh"),
        F.col("magnitude").alias("magnitude_kwh"), "symmetry", "sustained",
        F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
    )


def affected_feeders(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.explode(F.array("feeder_a", "feeder_b")).alias("feeder")).distinct()


def detection_floor(res: DataFrame, threshold_pct: float = 10.0) -> DataFrame:
    """Smallest transfer that stands out of the residual noise, in % and kWh of a median feeder."""
    rel = stage(
        res.where((F.col("prev") > 0) & F.col("delta").isNotNull()).select(
            "feeder", (F.abs(F.col("delta") / F.col("prev")) * 100.0).alias("rel")), "floor")
    median = exact_percentiles(rel, [], "rel", {"median": 0.5})
    median = stage(median, "floor")
    gap = rel.crossJoin(F.broadcast(median.select("median"))).select(F.abs(F.col("rel") - F.col("median")).alias("gap"))
    mad = exact_percentiles(gap, [], "gap", {"mad": 0.5}).select("mad")
    size = exact_percentiles(res, [], "kwh", {"size": 0.5}).select("size")
    noise = F.col("median") + MAD * F.col("mad")
    detectable = F.greatest(3.0 * noise, F.lit(threshold_pct))
    # One-row tables.
    return median.crossJoin(mad).crossJoin(size).where(F.col("n") >= 4).select(
        noise.alias("noise_pct"), F.lit(threshold_pct).alias("threshold_pct"), detectable.alias("detectable_pct"),
        (detectable / 100.0 * F.col("size")).alias("detectable_kwh"),
    )


def detection_status(head: DataFrame) -> DataFrame:
    """OK, or NO_APLICABLE_POR_DATOS with fewer than three periods."""
    return head.agg(F.count_distinct("period").alias("periods")).withColumn(
        "status", F.when(F.col("periods") < 3, "NO_APLICABLE_POR_DATOS").otherwise("OK"))
