"""Global ranks and exact percentiles that never gather a whole group in one task.

Both work the same way. Rows are range-partitioned by the ordering, each row is
stamped with the partition it fell into (ranks: with its place there, too), and the
stamped rows are staged. The
per-partition totals are tiny (one row per group and partition), so an offset per
partition turns a local position into a global one. A hot group simply spans more
range partitions; a hot *value* is collapsed beforehand (percentiles) or split by
the unique tie-break (ranks).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattledger.staging import stage


def _keyed(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def _join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` treating NULL as a group of its own."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def global_rank(
    df: DataFrame,
    order: Sequence[Column],
    *,
    partition: Sequence[str] = (),
    out: str = "rank",
) -> DataFrame:
    """1-based ``row_number`` over ``order`` within ``partition`` (default: everything).

    ``order`` must end in a unique column so that ties are broken and a hot value
    can be split over several range partitions.
    """
    # Sorted ranges are numbered on the way into the stage: the high bits are the range, the low ones the place in it.
    keys = [*_keyed(df, partition), *order]
    ranged = stage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
        .withColumn("__pid", F.shiftright("__at", 33).cast("int")),
        "rank",
    )
    # One row per group and range partition; the running window is over that.
    totals = ranged.groupBy(*partition, "__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    if partition:
        before = Window.partitionBy(*partition).orderBy("__pid")
    else:
        before = Window.partitionBy(F.lit(0)).orderBy("__pid")
    offsets = totals.select(
        *partition, "__pid",
        (F.sum("__n").over(before) - F.col("__n") - F.col("__first") + 1).alias("__offset"),
    )
    # One row per range partition, or a stage whose size decides: the ranked rows are not shuffled again for a small one.
    offsets = stage(offsets, "offsets") if partition else F.broadcast(offsets)
    joined = _join_keys(ranged, offsets, [*partition, "__pid"])
    return joined.withColumn(out, (F.col("__offset") + F.col("__at")).cast("bigint")).drop("__pid", "__at", "__offset")


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
) -> DataFrame:
    """Exact linear-interpolation percentiles of ``value`` per ``keys``.

    ``probs`` maps an output name to a probability; ``n`` is the number of
    non-null values. Equal values are counted before the shuffle, so neither a
    hot group nor a hot value ends in one task.
    """
    counted = (
        df.select(*keys, F.col(value).cast("double").alias("__v"))
        .where(F.col("__v").isNotNull() & ~F.isnan("__v"))
        .groupBy(*keys, "__v")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    ranged = stage(
        counted.repartitionByRange(*_keyed(counted, keys), F.col("__v")).withColumn(
            "__pid", F.spark_partition_id()
        ),
        "percentile",
    )
    totals = ranged.groupBy(*keys, "__pid").agg(F.sum("__c").alias("__n"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("__pid")
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = totals.select(
        *keys, "__pid", "__n",
        (F.sum("__n").over(before) - F.col("__n")).alias("__offset"),
        F.sum("__n").over(whole).alias("__total"),
    )
    ranks = {
        name: (F.floor((F.col("__total") - 1) * F.lit(p)), F.ceil((F.col("__total") - 1) * F.lit(p)))
        for name, p in probs.items()
    }
    end = F.col("__offset") + F.col("__n")
    wanted = F.lit(False)
    for lo, hi in ranks.values():
        for pos in (lo, hi):
            wanted = wanted | ((pos >= F.col("__offset")) & (pos < end))
    # Only the range partitions that hold a wanted position are read further.
    hits = _join_keys(ranged, offsets.where(wanted), [*keys, "__pid"])
    running = Window.partitionBy(*keys, "__pid").orderBy("__v")
    placed = hits.withColumn("__to", F.col("__offset") + F.sum("__c").over(running)).withColumn(
        "__from", F.col("__to") - F.col("__c")
    )

    def at(pos: Column) -> Column:
        return F.max(F.when((pos >= F.col("__from")) & (pos < F.col("__to")), F.col("__v")))

    aggs = [F.max("__total").alias("n")]
    for name, (lo, hi) in ranks.items():
        aggs += [at(lo).alias(f"__lo_{name}"), at(hi).alias(f"__hi_{name}")]
    found = placed.groupBy(*keys).agg(*aggs)
    cols = [*[F.col(k) for k in keys], F.col("n")]
    for name, p in probs.items():
        frac = (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        cols.append((low + (high - low) * frac).alias(name))
    return found.select(*cols)


def exact_percentiles_of(
    df: DataFrame, keys: Sequence[str], values: dict[str, dict[str, float]]
) -> DataFrame:
    """Percentiles of several columns per ``keys`` in one pass.

    ``values`` maps a column to its ``{output name: probability}``; ``n_<column>``
    counts its non-null values.
    """
    long = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("__metric"), F.col(c).cast("double").alias("__value")) for c in values
    ])))
    probs = sorted({p for wanted in values.values() for p in wanted.values()})
    names = {p: f"__p{i}" for i, p in enumerate(probs)}
    found = exact_percentiles(long, [*keys, "__metric"], "__value", {names[p]: p for p in probs})
    picks = []
    for c, wanted in values.items():
        mine = F.col("__metric") == c
        picks.append(F.max(F.when(mine, F.col("n"))).alias(f"n_{c}"))
        picks += [F.max(F.when(mine, F.col(names[p]))).alias(out) for out, p in wanted.items()]
    return found.groupBy(*keys).agg(*picks)


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-group ``stats`` back to rows.

    The statistics are staged: computed once, and with a known size from which the
    planner chooses a broadcast or a shuffle (with AQE skew handling).
    """
    return df.join(stage(stats, "stats"), list(keys), how)

