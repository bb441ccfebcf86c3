"""What has been loaded, what is missing, and how that degrades a consolidated balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of input that are tracked.
INPUTS = ["PADRON_COMERCIAL", "RED", "CABECERA"]


def mark_unknown(loads: DataFrame, universe: DataFrame) -> DataFrame:
    """Loads (one row per input and feeder) flagged when outside the declared universe."""
    known = universe.select("feeder").distinct().withColumn("__k", F.lit(True))
    return loads.join(known, "feeder", "left").withColumn("outside_universe", F.col("__k").isNull()).drop("__k")


def explode_loads(log: DataFrame) -> DataFrame:
    """Load log with a ``feeders`` array to one row per input and feeder, loads accumulated."""
    return log.select("input", F.explode("feeders").alias("feeder")).distinct()


def coverage(loads: DataFrame, universe: DataFrame, inputs: Sequence[str] = INPUTS) -> DataFrame:
    """Per input: feeders loaded, expected, coverage %, state, missing."""
    uni = universe.select("feeder").distinct()
    expected = uni.agg(F.count(F.lit(1)).alias("expected"))      # one row
    loaded = loads.select("input", "feeder").distinct().join(uni, "feeder", "left_semi").groupBy("input").agg(
        F.count(F.lit(1)).alias("loaded"))
    kinds = expected.select(F.explode(F.array(*[F.lit(i) for i in inputs])).alias("input"), "expected")
    out = kinds.join(loaded, "input", "left").withColumn("loaded", F.coalesce("loaded", F.lit(0)))
    return out.select(
        "input", "loaded", "expected",
        F.round(F.coalesce(F.col("loaded") * 100.0 / F.nullif("expected", F.lit(0)), F.lit(0.0)), 1).alias("coverage_pct"),
        F.when(F.col("loaded") == 0, "VACIA").when(F.col("loaded") >= F.col("expected"), "COMPLETA").otherwise("PARCIAL").alias("state"),
        (F.col("expected") - F.col("loaded")).alias("missing"),
    )


def pending(loads: DataFrame, universe: DataFrame, inputs: Sequence[str] = INPUTS) -> DataFrame:
    """Feeder and input still to load: the expected pairs minus the loaded ones."""
    wanted = universe.select("feeder").distinct().select(
        "feeder", F.explode(F.array(*[F.lit(i) for i in inputs])).alias("input"))
    return wanted.join(loads.select("feeder", "input").distinct(), ["feeder", "input"], "left_anti")


def ready_for_measured(loads: DataFrame) -> DataFrame:
    """Feeders with register, network and head energy: intersection of the three sets."""
    of = lambda kind: loads.where(F.col("input") == kind).select("feeder")
    return of("PADRON_COMERCIAL").intersect(of("RED")).intersect(of("CABECERA"))


def mark_partial(consolidated: DataFrame, loads: DataFrame, universe: DataFrame, minimum: float = 99.9) -> DataFrame:
    """Degrade the type to PARCIAL when too few feeders admit a measured balance."""
    uni = universe.select("feeder").distinct()
    ready = ready_for_measured(loads).join(uni, "feeder", "left_semi").agg(F.count(F.lit(1)).alias("__r"))
    total = uni.agg(F.count(F.lit(1)).alias("__t"))
    # Two one-row tables.
    pct = ready.crossJoin(total).select(
        F.when(F.col("__t") > 0, F.col("__r") * 100.0 / F.col("__t")).otherwise(F.lit(100.0)).alias("__pct"))
    return consolidated.crossJoin(F.broadcast(pct)).withColumns({
        "coverage_pct": F.round("__pct", 1),
        "balance_type": F.when(F.col("__pct") < minimum, F.lit("PARCIAL")).otherwise(F.col("balance_type")),
    }).drop("__pct")
