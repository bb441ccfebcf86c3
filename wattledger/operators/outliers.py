"""Unsupervised outlier score by isolation trees.

Every tree draws its own ``sample`` rows from all of them by a hash of tree and
account, so only ``trees x sample`` rows reach the driver. Every customer is then scored by
an Arrow-batched function over the trees, which weigh a few hundred kilobytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.operators.ranking import attach
from wattledger.staging import stage

_EULER = 0.5772156649


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Expected depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    long = 2.0 * (np.log(np.maximum(safe - 1.0, 1.0)) + _EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree as flat arrays; ``feature`` is -1 at a leaf, ``path`` its depth."""
    feature, cut, left, right, path = [], [], [], [], []
    todo = [(np.arange(len(x)), 0, None, None)]
    while todo:
        rows, d, parent, side = todo.pop()
        node = len(feature)
        if parent is not None:
            (left if side == 0 else right)[parent] = node
        for arr, v in ((feature, -1), (cut, 0.0), (left, node), (right, node)):
            arr.append(v)
        path.append(d + float(_mean_path(len(rows))))
        if d >= depth or len(rows) < 2:
            continue
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        open_ = np.flatnonzero(hi > lo)
        if open_.size == 0:
            continue
        f = int(rng.choice(open_))
        c = float(rng.uniform(lo[f], hi[f]))
        below = part[:, f] < c
        feature[node], cut[node] = f, c
        todo.append((rows[~below], d + 1, node, 1))
        todo.append((rows[below], d + 1, node, 0))
    return {
        "feature": np.array(feature), "cut": np.array(cut),
        "left": np.array(left), "right": np.array(right), "path": np.array(path),
    }


def fit_trees(
    df: DataFrame, features: Sequence[str], *, key: str = "account", trees: int = 150, sample: int = 256,
    seed: int = 20260807,
) -> tuple[list[dict[str, np.ndarray]], int] | None:
    """(trees, rows of a tree); None when there are fewer than 20 rows.

    A row is looked at once and dealt to the few trees whose draw it meets; what exceeds ``sample`` is cut per tree.
    """
    total = df.count()
    if total < 20:
        return None
    size = min(sample, total)
    share = (size + 6 * math.sqrt(size)) / total     # so that hardly any tree gets fewer than size
    draw = lambda tree: F.pmod(F.xxhash64(F.col(key), tree, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    dealt = (
        df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
        .withColumn("__tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < share)))
        .withColumn("__h", draw(F.col("__tree")))
    )
    place = F.row_number().over(W.partitionBy("__tree").orderBy("__h", *features))
    picked = dealt.withColumn("__n", place).where(F.col("__n") <= size).drop(key).toPandas()   # trees x sample at most
    depth = max(1, math.ceil(math.log2(size)))
    grown = [
        _grow(rows.sort_values("__n")[list(features)].to_numpy(dtype=float), depth, np.random.default_rng([seed, int(tree)]))
        for tree, rows in picked.groupby("__tree")
    ]
    return grown, size


def outlier_scores(
    df: DataFrame, features: Sequence[str], *, key: str = "account", trees: int = 150, sample: int = 256,
    seed: int = 20260807,
) -> DataFrame:
    """``(key, unsupervised)`` in [0, 1], 1 the most isolated; NULL when not fitted."""
    fitted = fit_trees(df, features, key=key, trees=trees, sample=sample, seed=seed)
    if fitted is None:
        return df.select(key, F.lit(None).cast("double").alias("unsupervised"))
    forest, size = fitted
    shared = df.sparkSession.sparkContext.broadcast(forest)
    norm = float(_mean_path(size))

    @F.pandas_udf(T.DoubleType())
    def isolation(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        grown = shared.value
        for columns in batches:
            x = np.column_stack([c.fillna(0.0).to_numpy(dtype=float) for c in columns])
            rows = np.arange(len(x))
            depth = np.zeros(len(x))
            for t in grown:
                at = np.zeros(len(x), dtype=np.int64)
                while True:
                    f = t["feature"][at]
                    go = f >= 0
                    if not go.any():
                        break
                    below = x[rows, np.maximum(f, 0)] < t["cut"][at]
                    at = np.where(go, np.where(below, t["left"][at], t["right"][at]), at)
                depth += t["path"][at]
            yield pd.Series(np.power(2.0, -depth / len(grown) / norm))

    # Many customers share a profile (most signals are zero): score each profile once.
    profiles = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]).distinct()
    scored = profiles.withColumn("__raw", isolation(*[F.col(c) for c in features]))
    scored = stage(scored, "isolation")
    span = scored.agg(F.min("__raw").alias("__lo"), F.max("__raw").alias("__hi"))   # one row
    width = F.col("__hi") - F.col("__lo")
    unit = scored.crossJoin(F.broadcast(span)).select(
        *features, F.when(width < 1e-12, F.lit(0.0)).otherwise((F.col("__raw") - F.col("__lo")) / width).alias("unsupervised")
    )
    rows = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    # Rows with no active signal share one profile: a broadcast (when small)
    # or AQE's skew join keeps that profile from landing in one task.
    return attach(rows, unit, list(features)).select(key, "unsupervised")
