"""Nearest neighbours by randomly rotated one-bit codes.

A bounded sample gives centroids; every vector belongs to the cell of its nearest one. The offset from the centroid is
rotated at random and kept as one bit a dimension, with two scalars: its length, and its inner product with its own
code. For a query, the bits give an estimate of the inner product of the offsets, and an error bound with it; only
vectors whose lower bound of the distance does not exceed the distance already reached are ranked again, on the original
vectors and in double precision.

A query is first compared with its own cell, whose result bounds the distance, then with the next cells. How many is
read off a bounded number of audited queries that are compared with all vectors: so many that the wanted share of their
true neighbours lies in them.

Vectors that are null, of no dimension, zero, or hold null or non-finite components take no part, nor do rows without
an id. Vectors of different dimension are not compared. Of the vectors of one id the smallest, component by component,
counts, and the others do not. Of equal vectors only the smallest ids can be among the nearest, so
the others are left out after their queries are taken: a group of copies costs no more than a few vectors. A query
without a candidate has no rows. Other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattledger.staging import stage

NEIGHBOURS = 10
EVERY = 100
#: Vectors wanted in a cell; of a cell's vectors and of its queries in one task.
CELL, BLOCK = 1024, 2048
#: Centroids at most, vectors of the sample for each, and components of all centroids together (they are given to every task).
MOST_CENTROIDS, SAMPLE_EACH, MOST_COMPONENTS = 16_384, 4, 1 << 20
ROUNDS = 4
#: Queries compared with everything, and the share of their neighbours that the cells searched must hold.
AUDITED, WANTED = 64, 0.97
#: Standard deviations of the estimate that the bound allows for.
DEVIATIONS = 4.0
SEED = 12_289


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits of the rotated rows, their lengths, and the inner product of each direction with its code."""
    length = np.linalg.norm(offsets, axis=1)
    turned = offsets @ rotation(offsets.shape[1])
    overlap = np.abs(turned).sum(axis=1) / np.sqrt(offsets.shape[1])
    own = np.divide(overlap, length, out=np.ones(len(offsets)), where=length > 0)
    return np.packbits(turned > 0, axis=1), length, own


def lower_bounds(queries: np.ndarray, codes: np.ndarray, length: np.ndarray, own: np.ndarray, deviations: float = DEVIATIONS) -> np.ndarray:
    """Squared distances (queries x codes) that the vectors behind the codes are hardly nearer than.

    ``queries`` are offsets from the same centroid. With unit directions q and x and code c, <q, c> / <x, c> estimates
    <q, x>; its error has a standard deviation of sqrt((1 - <x, c>**2) / <x, c>**2 / (dimensions - 1)).
    """
    dim = queries.shape[1]
    far = np.linalg.norm(queries, axis=1)
    turned = np.divide(queries, far[:, None], out=np.zeros(queries.shape), where=far[:, None] > 0) @ rotation(dim)
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    estimate = (turned.astype(np.float32) @ signs.T) / np.sqrt(dim) / own
    slack = deviations * np.sqrt(np.maximum(1 - own ** 2, 0) / max(dim - 1, 1)) / own
    # One bit too many of rounding is allowed for, as the estimate is in single precision.
    cosine = np.minimum(estimate + slack + 1e-5, 1)
    return far[:, None] ** 2 + length ** 2 - 2 * far[:, None] * length * cosine


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distance row by row in double precision, components added in their order."""
    total = np.zeros(len(queries))
    for k in range(queries.shape[1]):
        total += (queries[:, k] - vectors[:, k]) ** 2
    return np.sqrt(total)


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column])


def _sample_centroids(sample: np.ndarray, count: int) -> np.ndarray:
    """Lloyd's rounds over a bounded sample; an empty cell keeps its centroid."""
    cents = sample[:count].copy()
    for _ in range(ROUNDS):
        near = _nearest(sample, cents, 1)[:, 0]
        size = np.bincount(near, minlength=count)
        total = np.zeros(cents.shape)
        np.add.at(total, near, sample)
        cents[size > 0] = total[size > 0] / size[size > 0, None]
    return cents


def _nearest(x: np.ndarray, cents: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest centroids of each row, nearest first."""
    out = np.empty((len(x), count), np.int64)
    half = (cents ** 2).sum(axis=1) / 2
    for a in range(0, len(x), 1024):
        gap = half - x[a:a + 1024] @ cents.T
        part = np.argpartition(gap, count - 1, axis=1)[:, :count] if count < len(cents) else np.tile(np.arange(count), (len(gap), 1))
        order = np.argsort(np.take_along_axis(gap, part, 1), axis=1, kind="stable")
        out[a:a + 1024] = np.take_along_axis(part, order, 1)
    return out


def _usable(rows: DataFrame) -> DataFrame:
    x = F.col("vector")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0))


def _drawn(df: DataFrame, total: int, most: int, salt: int) -> DataFrame:
    """About ``most`` rows, ``most`` at most, drawn by a hash of the id; read in a fixed order."""
    draw = F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    few = df.where(draw <= 2 * most / max(total, 1))
    return few.orderBy(F.xxhash64("vec_id", F.lit(salt)), "vec_id").limit(most)


def _search(queries: pd.DataFrame, rows: pd.DataFrame, centroid: np.ndarray, keep: int) -> pd.DataFrame:
    """The ``keep`` nearest rows of each query within its bound, by codes and then by distance."""
    x, q = _matrix(rows["vector"]), _matrix(queries["vector"])
    codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
    low = lower_bounds(q - centroid, codes, rows["length"].to_numpy(), rows["own"].to_numpy())
    bound = queries["bound"].to_numpy(np.float64)
    # The rows that look nearest give a first bound of their own.
    few = min(keep, len(rows))
    hopeful = np.argpartition(low, few - 1, axis=1)[:, :few]
    if few == keep:
        reached = distances(np.repeat(q, few, axis=0), x[hopeful.ravel()]).reshape(-1, few).max(axis=1)
        bound = np.minimum(bound, reached)
    i, j = np.nonzero(low <= (bound ** 2)[:, None])
    gap = distances(q[i], x[j])
    near = gap <= bound[i]
    i, j, gap = i[near], j[near], gap[near]
    ids = rows["vec_id"].to_numpy()
    order = np.lexsort((ids[j], gap, i))
    i, j, gap = i[order], j[order], gap[order]
    first = np.searchsorted(i, np.arange(len(q)))
    best = np.arange(len(i)) - first[i] < keep
    return pd.DataFrame({"asker": queries["asker"].to_numpy()[i[best]], "vec_id": ids[j[best]], "score": gap[best]})


def _best(found: DataFrame, keep: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("asker").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= keep)


def _meet(index: DataFrame, asked: DataFrame, sizes: DataFrame, centroids, keep: int) -> DataFrame:
    """``asker, vec_id, score`` of ``asked(asker, vector, cell, bound)`` against the vectors of their cells.

    Cell sizes tell into how many blocks its vectors and its queries are cut; every block of queries meets every block
    of vectors, so a cell with a third of all rows is many tasks.
    """
    load = sizes.join(asked.groupBy("cell").agg(F.count(F.lit(1)).alias("asks")), "cell").select(
        "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("rows_in"), F.ceil(F.col("asks") / BLOCK).cast("int").alias("asks_in"))
    load = stage(load, "load")
    block = F.pmod(F.xxhash64("vec_id"), F.col("rows_in")).cast("int")
    left = index.join(load, "cell").withColumn("b", block).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("asks_in") - 1)))
    part = F.pmod(F.xxhash64("asker"), F.col("asks_in")).cast("int")
    right = asked.join(load, "cell").withColumn("a", part).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("rows_in") - 1)))

    def search(key, rows, queries):
        if not len(rows) or not len(queries):
            return pd.DataFrame(columns=["asker", "vec_id", "score"], dtype=object)
        return _search(queries, rows, centroids.value[key[0]], keep)

    key = ["cell", "a", "b"]
    return left.select(*key, "vec_id", "vector", "code", "length", "own").groupBy(*key).cogroup(
        right.select(*key, "asker", "vector", "bound").groupBy(*key)).applyInPandas(search, "asker long, vec_id long, score double")


def _audit(index: DataFrame, askers: DataFrame, total: int, cents: np.ndarray, keep: int) -> int:
    """Cells to search so that the audited queries find the wanted share of their true neighbours.

    The audited queries (a bounded number) are given to every task that holds vectors.
    """
    drawn = _drawn(askers.withColumnRenamed("asker", "vec_id"), total, AUDITED, 3).toPandas()
    if not len(drawn):
        return 1
    q = _matrix(drawn["vector"])

    def compare(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["vector"])
            gap = (q ** 2).sum(axis=1)[:, None] + (x ** 2).sum(axis=1) - 2 * q @ x.T
            few = min(keep, len(x))
            near = np.argpartition(gap, few - 1, axis=1)[:, :few]
            yield pd.DataFrame({
                "asker": np.repeat(np.arange(len(q)), few), "vec_id": pdf["vec_id"].to_numpy()[near.ravel()],
                "score": np.take_along_axis(gap, near, 1).ravel(), "cell": pdf["cell"].to_numpy()[near.ravel()]})

    true = _best(index.select("vec_id", "vector", "cell").mapInPandas(compare, "asker long, vec_id long, score double, cell int"), keep).toPandas()
    order = _nearest(q, cents, len(cents))
    place = np.empty_like(order)
    place[np.arange(len(q))[:, None], order] = np.arange(len(cents))
    steps = np.sort(place[true["asker"].to_numpy(), true["cell"].to_numpy()])
    return int(steps[int(np.ceil(WANTED * len(steps))) - 1]) + 1


FOUND = "query_id long, rank int, vec_id long, score double"


def _search_dimension(rows: DataFrame, queries: DataFrame, dim: int, keep: int) -> DataFrame:
    """``query_id, vec_id, score``: what the queries find among ``rows(vec_id, vector)``, all of ``dim`` dimensions."""
    spark = rows.sparkSession
    # Equal vectors are equally near to everything: the smallest ids stand for them, one more than is asked for, as one
    # may be the query's own.
    place = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    kept = stage(rows.withColumn("_k", place).where(F.col("_k") <= keep + 1).drop("_k"), "vectors")
    total = kept.count()
    count = int(min(max(-(-total // CELL), 1), MOST_CENTROIDS, max(MOST_COMPONENTS // dim, 1)))
    sample = _matrix(_drawn(kept, total, SAMPLE_EACH * count, 1).toPandas()["vector"])
    cents = _sample_centroids(sample, min(count, len(sample)))
    shared = spark.sparkContext.broadcast(cents)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["vector"])
                cell = _nearest(x, shared.value, 1)[:, 0]
                codes, length, own = encode(x - shared.value[cell])
                yield pdf.assign(cell=cell, code=[c.tobytes() for c in codes], length=length, own=own)

    index = stage(kept.mapInPandas(assign, "vec_id long, vector array<double>, cell int, code binary, length double, own double"), "codes")
    sizes = stage(index.groupBy("cell").count(), "cells")
    # Queries with the same vector ask once.
    asking = stage(queries.groupBy("vector").agg(F.min("vec_id").alias("asker")), "askers")
    probes = _audit(index, asking, asking.count(), cents, keep + 1)

    def route(batches):
        for pdf in batches:
            if len(pdf):
                near = _nearest(_matrix(pdf["vector"]), shared.value, min(probes, len(shared.value)))
                yield pdf.assign(cells=list(near.astype(np.int32)))

    routed = stage(asking.mapInPandas(route, "vector array<double>, asker long, cells array<int>"), "routed")
    ask = routed.select("asker", "vector", F.posexplode("cells").alias("step", "cell"))
    home = stage(_meet(index, ask.where("step = 0").withColumn("bound", F.lit(float("inf"))), sizes, shared, keep + 1), "home")
    reached = home.transform(lambda d: _best(d, keep + 1)).groupBy("asker").agg(
        F.when(F.count(F.lit(1)) > keep, F.max("score")).alias("bound"))
    onward = ask.where("step > 0").join(reached, "asker", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    more = _meet(index, onward, sizes, shared, keep + 1)
    best = stage(_best(home.unionByName(more), keep + 1).select("asker", "vec_id", "score"), "best")
    # The copies' answers: the ids of the query's own row go.
    named = queries.join(asking, "vector").select(F.col("vec_id").alias("query_id"), "asker")
    return named.join(best, "asker").where("vec_id <> query_id").select("query_id", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, every: int = EVERY, keep: int = NEIGHBOURS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest of ``vectors(vec_id, embedding)`` to each whose id ``every`` divides.

    ``score`` is the Euclidean distance of the original vectors. Ties go to the smaller id.
    """
    rows = _usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")))
    rows = stage(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector")), "usable")
    out = None
    for dim in sorted(r.dim for r in rows.select("dim").distinct().collect()):
        here = rows.where(F.col("dim") == dim).drop("dim")
        found = _search_dimension(here, here.where(F.col("vec_id") % every == 0), dim, keep)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= keep).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH x AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
  GROUP BY vec_id),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) AS score
  FROM x q JOIN x c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {NEIGHBOURS}
"""
