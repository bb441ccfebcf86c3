"""Connected components of an edge table, and the small version used inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.staging import stage


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))), F.lit(0))).first()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable from each node of ``edges(u, v)``; nodes without an edge are absent.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the smallest. Each half is a
    minimum by key (combined before the shuffle) and an equi-join that adaptive execution may split, so a hub with a
    third of all edges is never gathered. Rounds are staged; the driver sees two numbers a round. Rows with a null end
    and loops are ignored; repeated edges count once; an empty table gives an empty table.
    """
    pairs = edges.where("u is not null and v is not null and u <> v")
    now = stage(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _fingerprint(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        last, seen, now = seen, _fingerprint(after), after
        if tuple(seen) == tuple(last):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def local_roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable from each of ``n`` nodes over the edges ``a[i]-b[i]`` held in memory."""
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    label = rank.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        order = np.argsort(rank)
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            return np.sort(ids, kind="stable")[label]
        label = new
