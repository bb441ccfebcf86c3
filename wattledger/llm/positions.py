"""Positions of rows in a total order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattledger.staging import stage


def positions(df: DataFrame, by: list[str], order: list[str], size: str, ahead: str, total: str) -> DataFrame:
    """Adds ``ahead``: the sum of ``size`` over the rows of the same ``by`` that come earlier in ``order``, and
    ``total``: that sum over all of them. ``by`` may be empty.

    Rows are dealt by ranges of (by, order, arrival), so a key with a third of all rows is cut into many ranges, even
    where its rows are equal. Each range adds up its own rows; one small table of (range, key) sums gives the offsets.
    The rows are staged with their range number, so that a lost executor cannot move a row to another range.
    """
    ranged = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*by, *order, "_tie").withColumn("_range", F.spark_partition_id())
    rows = stage(ranged, "ranges")
    # A range of the order holds few keys, but is dealt to a partition by its number alone.
    inner = W.partitionBy("_range", *by).orderBy(*order, "_tie").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("_range", *by).agg(F.sum(size).alias("_sum"))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = stage(sums.select(
        F.col("_range").alias("_r"), *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)],
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(W.partitionBy(*by)).alias(total),
    ), "offsets")
    match = F.col("_range") == F.col("_r")
    for k, c in enumerate(by):
        match &= F.col(c).eqNullSafe(F.col(f"_by{k}"))
    placed = rows.withColumn("_local", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    out = placed.join(offsets, match).withColumn(ahead, F.col("_local") + F.col("_offset"))
    return out.drop("_tie", "_range", "_r", "_local", "_offset", *[f"_by{k}" for k in range(len(by))])
