"""Sharding by proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; row i of n has the fractional rank (i + 1/2) / n. In order of
fractional rank every stretch of the corpus holds the sources in the proportions of the whole, so equal cuts of that
order are shards that match the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.llm.positions import positions

SHARDS = 8
SEED = 29
#: Shards differ by one row at most.
LAW = "rows"


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 within a shard).

    ``docs`` needs ``doc_id`` and ``source``; its other columns are carried, so keep it narrow and write texts through a
    join. The order of a source is by hash of id and seed, then by id and the other columns' hash, so it does not depend
    on how rows arrive. A null source is a source; null ids, repeated rows and equal texts are rows like others; an empty table
    gives no rows. With fewer rows than shards some shards are empty. No source and no group of equal rows meets in one
    task: both orders are cut into ranges.
    """
    carried = [c for c in docs.columns]
    keyed = docs.select(F.struct(*carried).alias("_row"), F.col("source").cast("string").alias("_source"), F.lit(1).cast("long").alias("_one"),
                        F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("_draw"), F.xxhash64(*[F.col(c) for c in carried]).alias("_rest"))
    ranked = positions(keyed, ["_source"], ["_draw", "_rest"], "_one", "_rank", "_of")
    ordered = ranked.withColumn("_fraction", (F.col("_rank") + 0.5) / F.col("_of")).drop("_rank", "_of")
    placed = positions(ordered, [], ["_fraction", "_source", "_draw", "_rest"], "_one", "_at", "_all")
    # Shard k holds the positions from ceil(k * all / shards) on.
    shard = F.floor(F.col("_at") * F.lit(shards) / F.col("_all")).cast("long")
    exact = F.when(_first(shard + 1, shards) <= F.col("_at"), shard + 1).when(_first(shard, shards) > F.col("_at"), shard - 1).otherwise(shard)
    return placed.withColumn("_shard", exact).select(
        "_row.*", F.col("_shard").cast("int").alias("shard"), (F.col("_at") - _first(F.col("_shard"), shards)).cast("long").alias("slot"))


def _first(shard, shards: int):
    return F.floor((shard * F.col("_all") + F.lit(shards - 1)) / F.lit(shards)).cast("long")


def shard_report(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, text_crc32, law, shard, slot, grown_shard``: size is UTF-8 bytes plus 1 (null text: 1),
    crc32 that of the text (null text: of no bytes), the law ``rows``, under which ``grown_shard`` is null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return interleave(narrow, shards, seed).select(
        "doc_id", "source", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
