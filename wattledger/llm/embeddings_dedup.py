"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors are dealt to overlapping cluster shards (each to its two nearest centroids, level by level while a shard is too
large). Each shard builds a graph: nearest neighbours thinned by robust pruning, so that long edges stay. The adjacency
lists of a vector are united over its shards. Every vector is then searched for in its shards: a greedy search from the
medoid, then an expansion through everything within range. Links are verified in double precision; a sample of the
vectors is compared with all others to audit the recall.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattledger.llm.components import components, local_roots
from wattledger.llm.words import mix
from wattledger.staging import stage

THRESHOLD = 0.93
#: Vectors of a shard beyond which it is split; of a shard that cannot be split, blocks of this size.
SHARD = 2048
OVERLAP = 2
MOST_CENTROIDS = 256
#: Centroids closer than this are one: a dense group has one centroid, and so one shard.
DISTINCT_CENTROIDS = 0.8
DEGREE, ALPHA, NEIGHBOURS = 24, 1.2, 64
BEAM = 12
#: Edges of a node in a search, of those in its united list and those that lead to it.
MOST_EDGES = 3 * DEGREE
#: The expansion goes on through vectors this far below the threshold.
SLACK = 0.06
AUDITED = 64


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column])


def _assigner(batches):
    for pdf in batches:
        out = []
        for cell, rows in pdf.groupby("cell", sort=False):
            cents = _unit(_matrix(rows["centroids"].iloc[0]))
            kept = [0]
            for i in range(1, len(cents)):
                if (cents[kept] @ cents[i]).max() < DISTINCT_CENTROIDS:
                    kept.append(i)
            if len(kept) < 3:
                out.append(pd.DataFrame({"rep": rows["rep"], "cell": rows["cell"], "parent": rows["cell"], "final": True}))
                continue
            near = np.argsort(-(_unit(_matrix(rows["embedding"])) @ cents[kept].T), axis=1, kind="stable")[:, :OVERLAP]
            for k in range(OVERLAP):
                pick = np.array(kept)[near[:, k]].astype(np.uint64)
                mixed = mix(mix(np.full(len(pick), cell, np.int64).view(np.uint64)) + pick)
                out.append(pd.DataFrame({"rep": rows["rep"], "cell": mixed.view(np.int64), "parent": rows["cell"], "final": False}))
        if out:
            yield pd.concat(out)


def shard_vectors(reps: DataFrame) -> DataFrame:
    """``rep, cell``: the overlapping shards of each vector of ``reps(rep, cell, embedding)``.

    A shard beyond ``SHARD`` vectors is split around a sample of its own members, at most ``MOST_CENTROIDS``, thinned so
    that no two are near. A shard that its centroids do not spread (a dense group) stays whole and is searched in blocks.
    """
    done, todo = None, stage(reps.select("rep", "cell"), "cells")
    level = 0
    while True:
        sizes = stage(todo.groupBy("cell").count(), "sizes")
        small = todo.join(sizes.where(F.col("count") <= SHARD).select("cell"), "cell").select("rep", "cell")
        done = small if done is None else done.union(small)
        large = sizes.where(F.col("count") > SHARD)
        if large.isEmpty():
            return done
        member = todo.join(large, "cell").join(reps.select("rep", "embedding"), "rep")
        most = F.least(F.lit(MOST_CENTROIDS), 2 * F.ceil(F.col("count") / SHARD) + 2)
        draw = F.pmod(F.xxhash64("rep", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
        drawn = member.where(draw < 4 * most / F.col("count") + 1e-9).withColumn("_k", F.row_number().over(W.partitionBy("cell").orderBy(F.xxhash64("rep", F.lit(level)), "rep")))
        centroids = drawn.where(F.col("_k") <= most).groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "embedding"))), lambda x: x.embedding).alias("centroids"))
        split = stage(member.join(centroids, "cell").select("rep", "cell", "embedding", "centroids").mapInPandas(_assigner, "rep long, cell long, parent long, final boolean"), "split")
        # A child with most of its parent, or a parent without centroids of its own, cannot be split further.
        parents = large.select(F.col("cell").alias("parent"), F.col("count").alias("whole"))
        children = split.groupBy("cell", "parent").count().join(parents, "parent")
        ends = split.where("final").select("cell").distinct().union(children.where("count > 0.8 * whole").select("cell")).distinct()
        done = done.union(split.join(ends, "cell", "left_semi").select("rep", "cell"))
        todo = stage(split.join(ends, "cell", "left_anti").select("rep", "cell").distinct(), "cells")
        level += 1


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Adjacency (rows x degree, -1 padded) of unit vectors: from the nearest on, a neighbour is taken unless one taken
    before is ``alpha`` times closer to it than the vector itself."""
    n = len(x)
    out = np.full((n, degree), -1, np.int32)
    k = min(NEIGHBOURS, n - 1)
    if k < 1:
        return out
    for a in range(0, n, 512):
        sims = x[a:a + 512] @ x.T
        rows = np.arange(len(sims))
        sims[rows, a + rows] = -2
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        dist = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(sims, near, 1), 0))
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("nkd,njd->nkj", x[near], x[near], optimize=True), 0))
        alive = np.ones(near.shape, bool)
        taken = np.zeros(len(near), np.int64)
        for j in range(k):
            take = alive[:, j] & (taken < degree)
            r = np.flatnonzero(take)
            out[a + r, taken[r]] = near[r, j]
            taken[r] += 1
            alive[r] &= alpha * between[r, j] > dist[r]
    return out


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates("rep").sort_values("rep")
    ids = rows["rep"].to_numpy()
    adjacency = robust_prune(_unit(_matrix(rows["embedding"])).astype(np.float32))
    return pd.DataFrame({"rep": ids, "near": [ids[a[a >= 0]] for a in adjacency]})


def range_search(queries: np.ndarray, x: np.ndarray, adjacency: np.ndarray, seeds: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) of similarity ``threshold`` or a little less, found over the graph.

    A greedy search with a beam starts at the medoid; the expansion then visits the neighbours of everything in range,
    beginning with what the search met and with ``seeds`` (a query's own node, -1 if it has none).
    """
    n, m = len(queries), len(x)
    met = np.full((n, m), -2, np.float32)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    met[:, medoid] = queries @ x[medoid]
    beam = np.full((n, BEAM), -1, np.int64)
    score = np.full((n, BEAM), -3, np.float32)
    opened = np.ones((n, BEAM), bool)
    beam[:, 0], score[:, 0], opened[:, 0] = medoid, met[:, medoid], False
    while True:
        q = np.flatnonzero(~opened.all(axis=1))
        if not len(q):
            break
        at = np.argmax(np.where(opened[q], -9, score[q]), axis=1)
        opened[q, at] = True
        near = adjacency[beam[q, at]]
        fresh = (near >= 0) & (met[q[:, None], near] < -1.5)
        s = np.where(fresh, np.einsum("nkd,nd->nk", x[near], queries[q]), -3).astype(np.float32)
        i, j = np.nonzero(fresh)
        met[q[i], near[i, j]] = s[i, j]
        all_score = np.concatenate([score[q], s], axis=1)
        top = np.argsort(-all_score, axis=1, kind="stable")[:, :BEAM]
        score[q] = np.take_along_axis(all_score, top, 1)
        beam[q] = np.take_along_axis(np.concatenate([beam[q], near], axis=1), top, 1)
        opened[q] = np.take_along_axis(np.concatenate([opened[q], ~fresh], axis=1), top, 1)
    own = np.flatnonzero(seeds >= 0)
    met[own, seeds[own]] = 1
    reach = threshold - SLACK
    expanded = np.zeros((n, m), bool)
    while True:
        i, j = np.nonzero((met >= reach) & ~expanded)
        if not len(i):
            break
        expanded[i, j] = True
        wanted = np.zeros((n, m), bool)
        for a in range(0, len(i), 100_000):
            near = adjacency[j[a:a + 100_000]]
            r, k = np.nonzero(near >= 0)
            wanted[i[a:a + 100_000][r], near[r, k]] = True
        wanted &= met < -1.5
        i, j = np.nonzero(wanted)
        for a in range(0, len(i), 100_000):
            r, k = i[a:a + 100_000], j[a:a + 100_000]
            met[r, k] = np.einsum("nd,nd->n", queries[r], x[k])
    return np.nonzero(met >= threshold - 1e-4)


def _padded(lists) -> np.ndarray:
    width = max((len(v) for v in lists), default=1)
    out = np.full((len(lists), max(width, 1)), np.iinfo(np.int64).max)
    for k, v in enumerate(lists):
        out[k, :len(v)] = v
    return out


def _searcher(threshold: float):
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        asking = rows[rows["asks"]].drop_duplicates("rep").sort_values("rep").reset_index(drop=True)
        index = rows[~rows["asks"]].drop_duplicates("rep").sort_values("rep").reset_index(drop=True)
        if not len(asking) or not len(index):
            return pd.DataFrame({"rep": asking["rep"], "links": np.int64(0), "root": asking["rep"]})
        cell = int(rows["cell"].iloc[0])
        q, x = _unit(_matrix(asking["embedding"])), _unit(_matrix(index["embedding"]))
        ids = index["rep"].to_numpy()
        lists = [np.asarray(v, np.int64) for v in index["near"]]
        flat = np.concatenate(lists)
        owner = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
        spot = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        here = ids[spot] == flat
        # Both directions of an edge, the nearest of a node first: no vector is without a way in.
        pair = np.unique(np.concatenate([owner[here] * len(ids) + spot[here], spot[here] * len(ids) + owner[here]]))
        owner, spot = pair // len(ids), pair % len(ids)
        order = np.lexsort((-np.einsum("nd,nd->n", x[owner], x[spot]), owner))
        owner, spot = owner[order], spot[order]
        near = np.arange(len(owner)) - np.searchsorted(owner, owner) < MOST_EDGES
        owner, spot = owner[near], spot[near]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        adjacency = np.full((len(ids), int(place.max(initial=0)) + 1), -1, np.int64)
        adjacency[owner, place] = spot
        asked = asking["rep"].to_numpy()
        own = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
        seeds = np.where(ids[own] == asked, own, -1)
        i, j = range_search(q.astype(np.float32), x.astype(np.float32), adjacency, seeds, threshold)
        # Once a pair, in the smallest shard that both are in; then the exact test.
        cq, cx = _padded(asking["cells"]), _padded(index["cells"])
        good = asked[i] != ids[j]
        i, j = i[good], j[good]
        for a in range(0, len(i), 200_000):
            s = slice(a, a + 200_000)
            earlier = ((cq[i[s]][:, :, None] == cx[j[s]][:, None, :]) & (cq[i[s]] < cell)[:, :, None]).any(axis=(1, 2))
            exact = np.einsum("nd,nd->n", q[i[s]], x[j[s]]) >= threshold
            good = exact & ~earlier if a == 0 else np.concatenate([good, exact & ~earlier])
        if len(i):
            i, j = i[good], j[good]
        links = np.zeros(len(asked), np.int64)
        np.add.at(links, i, index["copies"].to_numpy()[j])
        every = np.concatenate([asked, ids])
        root = local_roots(len(every), i, len(asked) + j, every)
        linked = np.zeros(len(every), bool)
        linked[i] = linked[len(asked) + j] = True
        tail = linked[len(asked):]
        return pd.concat([
            pd.DataFrame({"rep": asked, "links": links, "root": root[:len(asked)]}),
            pd.DataFrame({"rep": ids[tail], "links": np.int64(0), "root": root[len(asked):][tail]}),
        ])
    return search


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can link: id and label given, and a vector of finite components that is not zero."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)).where(
        F.coalesce(finite, F.lit(False)) & F.exists(e, lambda v: v != 0))


def link_embeddings(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept, audit_recall``.

    Only vectors of equal, non-null label (and equal length) are compared, by cosine in double precision. Vectors that
    are null, empty, zero or hold null or non-finite components, and rows without label, link with nothing and are
    components of their own; a row without vec_id also has no component and is not kept. Repeated rows are vectors of
    their own: equal vectors are compared once and counted by their copies. An empty table gives no rows. Other columns
    are not read. ``audit_recall`` is the share of the links of ``AUDITED`` vectors (by hash) that was found.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    good = usable(base)
    reps = stage(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn(
        "cell", F.xxhash64("label", F.size("embedding"))), "vectors")
    # Two vectors of one id: the larger group of equal vectors takes the id, the other is told apart by a hash.
    twice = W.partitionBy("rep").orderBy(F.col("copies").desc(), "label", F.xxhash64("embedding"))
    reps = stage(reps.withColumn("_n", F.row_number().over(twice)).withColumn("id", F.col("rep")).withColumn(
        "rep", F.when(F.col("_n") == 1, F.col("rep")).otherwise(F.xxhash64("rep", "label", "embedding"))).drop("_n"), "vectors")
    shards = shard_vectors(reps)
    cells = shards.groupBy("rep").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    nodes = stage(reps.drop("cell").join(cells, "rep"), "nodes")
    placed = nodes.withColumn("cell", F.explode("cells"))
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("blocks"))
    placed = placed.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    graph = placed.select("cell", "block", "rep", "embedding").groupBy("cell", "block").applyInPandas(_build, "rep long, near array<long>")
    adjacency = stage(graph.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    full = placed.join(adjacency, "rep").select("cell", "block", "blocks", "rep", "copies", "embedding", "cells", "near")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asks = full.withColumn("against", other).withColumn("asks", F.lit(True)).select("cell", "block", "against", "rep", "copies", "embedding", "cells", F.array().cast("array<long>").alias("near"), "asks")
    index = full.withColumn("against", F.col("block")).withColumn("block", other).withColumn("asks", F.lit(False)).select("cell", "block", "against", "rep", "copies", "embedding", "cells", "near", "asks")
    found = stage(asks.union(index).groupBy("cell", "block", "against").applyInPandas(_searcher(threshold), "rep long, links long, root long"), "found")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("root <> rep").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    known = reps.select("rep", "id", "label", "embedding", "copies").join(links, "rep").join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    known = stage(known, "linked")
    names = known.groupBy("root").agg(F.min("id").alias("component_id"))
    known = known.join(names, "root").select("label", "embedding", "component_id", (F.col("copies") - 1 + F.col("links")).alias("links"))
    known = stage(known, "known")
    joined = base.join(known, ["label", "embedding"], "left").select(
        "vec_id", "label", "embedding", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    recall = audit_recall(good, joined, threshold)
    return joined.crossJoin(F.broadcast(recall)).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), "audit_recall")


def audit_recall(good: DataFrame, linked: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row, ``audit_recall``: links found over links that exist, for ``AUDITED`` vectors against all others."""
    asked = good.orderBy(F.xxhash64("vec_id", F.lit(AUDITED)), "vec_id").limit(AUDITED).collect()  # bounded
    labels = np.array([r.label for r in asked], np.int64)
    vectors = [np.asarray(r.embedding) / np.linalg.norm(r.embedding) for r in asked]

    def compare(batches):
        for pdf in batches:
            count = np.zeros(len(asked), np.int64)
            for size, rows in pdf.groupby(pdf["embedding"].map(len)):
                x, own = _unit(_matrix(rows["embedding"])), rows["label"].to_numpy()
                for k, v in enumerate(vectors):
                    if len(v) == size:
                        count[k] += int(((x @ v >= threshold) & (own == labels[k])).sum())
            yield pd.DataFrame({"k": np.arange(len(asked)), "n": count})

    if not asked:
        return good.sparkSession.range(1).select(F.lit(1.0).alias("audit_recall"))
    there = good.select("embedding", "label").mapInPandas(compare, "k int, n long").agg((F.sum("n") - len(asked)).alias("there"))
    ids = sorted({r.vec_id for r in asked})
    got = linked.where(F.col("vec_id").isin(ids)).agg(F.sum("n_links").alias("got"))
    return there.crossJoin(got).select(F.when(F.col("there") > 0, F.least(F.lit(1.0), F.col("got") / F.col("there"))).otherwise(F.lit(1.0)).alias("audit_recall"))
