"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles. Equal sets are one class. Classes that agree on a band of MinHash values are
candidates; inside a group of candidates, MinHash values are compared a few at a time, and a pair is dropped as soon as
the posterior probability that its similarity reaches the threshold falls below the tolerance. The rest is verified on
the whole sets.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.llm.components import components, local_roots
from wattledger.llm.words import chunks, hash_words, mix, shingles, signed, sorted_sets
from wattledger.staging import settle, stage

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at similarity 0.8 shares no band with probability (1 - 0.8**5)**40, about 1e-7.
BANDS, BAND_ROWS = 40, 5
STEP = 40
TOLERANCE = 1e-6
#: Classes and shingles of one side of a block of candidates.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 1_000_000

_RNG = np.random.default_rng(7_919)
_A = _RNG.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)
_BAND_MIX = mix(np.arange(1, BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def minhash(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values (rows x hashes, 32 bits) of non-empty slices."""
    out = np.empty((len(offsets) - 1, len(_A)), np.uint32)
    if len(out):
        for k, (a, b) in enumerate(zip(_A, _B)):
            out[:, k] = np.minimum.reduceat((values * a + b) >> np.uint64(32), offsets[:-1])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band (rows x bands)."""
    parts = signature.reshape(len(signature), BANDS, BAND_ROWS).astype(np.uint64)
    return mix((parts * _BAND_MIX).sum(axis=2, dtype=np.uint64) + mix(np.arange(1, BANDS + 1, dtype=np.uint64)))


def least_matches(threshold: float, hashes: int, step: int = STEP, tolerance: float = TOLERANCE) -> list[int]:
    """Fewest equal values after step, 2 step, ... at which a pair is kept.

    With a uniform prior, m equal of n values leave a Beta(m + 1, n - m + 1) posterior. Its tail above the threshold is
    the chance that at most m of n + 1 draws at the threshold succeed.
    """
    out = []
    for n in range(step, hashes + 1, step):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out.append(m)
    return out


def _sketch(batches):
    for batch in batches:
        for first, texts in chunks(batch["text"]):
            values, offsets = sorted_sets(*shingles(hash_words(texts), SHINGLE))
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            starts = offsets[full]
            sums = np.zeros((2, len(texts)), np.uint64)
            bands = [None] * len(texts)
            if len(full):
                sums[0, full] = np.add.reduceat(values, starts)
                sums[1, full] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts) + n[full].astype(np.uint64)
                keys = signed(band_keys(minhash(values, np.append(starts, len(values)))))
                for i, row in zip(full, keys):
                    bands[i] = row
            rows = batch.iloc[first:first + len(texts)]
            yield pd.DataFrame({
                "doc_id": rows["doc_id"].to_numpy(), "text_hash": rows["text_hash"].to_numpy(), "shingles": n,
                "h1": signed(mix(sums[0])), "h2": signed(mix(sums[1])), "bands": bands,
            })


def _pairs(keep: np.ndarray, left: list, right: list, sizes_l: np.ndarray, sizes_r: np.ndarray, threshold: float):
    """Verified pairs (i, j) among those marked in ``keep``: exact similarity of the whole sets."""
    found_i, found_j = [], []
    for i in np.flatnonzero(keep.any(axis=1)):
        js = np.flatnonzero(keep[i])
        js = js[np.minimum(sizes_r[js], sizes_l[i]) >= threshold * np.maximum(sizes_r[js], sizes_l[i]) - 1e-9]
        if not len(js):
            continue
        own = left[i]
        at = np.concatenate([[0], np.cumsum(sizes_r[js])])
        other = np.concatenate([right[j] for j in js])
        spot = np.minimum(np.searchsorted(own, other), len(own) - 1)
        common = np.add.reduceat((own[spot] == other).astype(np.int64), at[:-1])
        union = sizes_l[i] + sizes_r[js] - common
        good = js[common / union >= threshold - 1e-12]
        found_i.append(np.full(len(good), i))
        found_j.append(good)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, int), np.zeros(0, int))


def _compare(threshold: float):
    least = least_matches(threshold, len(_A))

    def sets(texts):
        out, sigs = [], []
        for _, part in chunks(texts):
            values, offsets = sorted_sets(*shingles(hash_words(part), SHINGLE))
            out += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            sigs.append(minhash(values, offsets))
        return out, np.concatenate(sigs)

    def survivors(sl, sr):
        keep = np.ones((len(sl), len(sr)), bool)
        for k, m in enumerate(least):
            i, j = np.nonzero(keep)
            if not len(i):
                break
            cut = slice(k * STEP, (k + 1) * STEP)
            if k == 0:
                count = np.zeros(keep.shape, np.int16)
                for c in range(STEP):
                    count += sl[:, c][:, None] == sr[:, c][None, :]
            else:
                for a in range(0, len(i), 50_000):
                    count[i[a:a + 50_000], j[a:a + 50_000]] += (sl[i[a:a + 50_000], cut] == sr[j[a:a + 50_000], cut]).sum(axis=1).astype(np.int16)
            keep &= count >= m
        return keep

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["component", "first", "second", "h1", "h2"]).sort_values(["component", "first", "second", "h1", "h2"]).reset_index(drop=True)
        shingle_sets, sigs = sets(rows["text"])
        n = np.array([len(s) for s in shingle_sets], np.int64)
        h1, copies = rows["h1"].to_numpy(), rows["copies"].to_numpy()
        links = np.zeros(len(rows), np.int64)
        root = h1.copy()
        for at in rows.groupby(["component", "first", "second"], sort=False).indices.values():
            one = rows.iloc[at[0]]
            same = one["first"] == one["second"]
            block = rows["block"].to_numpy()[at]
            left = at[block == one["first"]]
            right = at if same else at[block == one["second"]]
            if not len(left) or not len(right):
                continue
            keep = survivors(sigs[left], sigs[right])
            if same:
                keep = np.triu(keep, 1)
            i, j = _pairs(keep, [shingle_sets[x] for x in left], [shingle_sets[x] for x in right], n[left], n[right], threshold)
            a, b = left[i], right[j]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            local = np.full(len(rows), -1)
            local[at] = np.arange(len(at))
            root[at] = np.minimum(root[at], local_roots(len(at), local[a], local[b], h1[at]))
        return pd.DataFrame({"h1": h1, "h2": rows["h2"].to_numpy(), "links": links, "root": root})

    return compare


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, text_hash, shingles, n_links, component_id, kept``.

    ``n_links``: other documents of similarity ``threshold`` or more. ``component_id``: the smallest doc_id reachable by
    links, itself included; ``kept``: the document that has it (with the least text hash, if several share the id). Only
    ``doc_id`` and ``text`` are read. A text of one to four words is one shingle; null, empty and blank texts have none,
    link with nothing and are kept. Rows without a doc_id are compared and counted as others are, but come last when a
    component is named (null if none of its rows has an id). Rows that repeat id and text are documents of their own,
    told apart by nothing, so they are kept together; ``drop_near_duplicates`` leaves one. An empty table gives no rows.
    Classes are told apart by 128 bits and named by 64 in edges.

    Shuffled: one key per band and class, the members of candidate groups with their texts. A candidate group beyond a
    block is compared block by block, each pair of blocks a task; only counts and a spanning forest leave a task.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    sketch = stage(base.mapInPandas(_sketch, "doc_id long, text_hash long, shingles long, h1 long, h2 long, bands array<long>"), "sketches")
    full = sketch.where("shingles > 0")
    owner = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    classes = stage(full.groupBy("h1", "h2").agg(
        F.count("*").alias("copies"), F.min(owner).alias("_o"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands"),
    ).select("h1", "h2", "copies", "shingles", "bands", F.col("_o.doc_id").alias("doc_id"), F.col("_o.text_hash").alias("text_hash")), "classes")

    keys = classes.select("h1", F.explode("bands").alias("band"))
    shared = stage(keys.groupBy("band").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("band", "low"), "bands")
    edges = keys.join(shared, "band").select(F.col("h1").alias("u"), F.col("low").alias("v"))
    grouped = stage(components(edges).join(classes.drop("bands"), F.col("node") == F.col("h1")).select(
        "h1", "h2", "copies", "shingles", "doc_id", "text_hash", F.col("root").alias("component")), "candidates")

    sizes = grouped.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    units = max(1, grouped.count() // BLOCK_CLASSES)
    placed = grouped.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("h1", "h2"), "blocks").cast("int"))
    wanted = base.join(placed, base.doc_id.eqNullSafe(placed.doc_id) & (base.text_hash == placed.text_hash), "inner").select(
        "component", "block", "blocks", "h1", "h2", "copies", "text")
    once = wanted.groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("component", "block", "blocks", "copies", "text")])
    paired = once.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", "block", "h1", "h2", "copies", "text", F.least("block", "_other").alias("first"), F.greatest("block", "_other").alias("second"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(units))).otherwise(F.xxhash64("component", F.least("block", "_other"), F.greatest("block", "_other"))).alias("unit"))
    compared = stage(paired.groupBy("unit").applyInPandas(_compare(threshold), "h1 long, h2 long, links long, root long"), "compared")

    roots = components(compared.where("root <> h1").select(F.col("h1").alias("u"), F.col("root").alias("v")))
    links = compared.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    known = stage(classes.drop("bands", "shingles").join(links, ["h1", "h2"], "left").join(roots, F.col("h1") == F.col("node"), "left").select(
        "h1", "h2", "copies", "doc_id", "text_hash", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "h1").alias("root"), F.coalesce(F.col("root").cast("string"), F.concat_ws("/", "h1", "h2")).alias("group")), "linked")
    names = known.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("_o"))
    named = known.join(names, "group").select("h1", "h2", "copies", "links", F.col("_o.doc_id").alias("component_id"), F.col("_o.text_hash").alias("keeper"))
    some = F.col("shingles") > 0
    return sketch.drop("bands").join(named, ["h1", "h2"], "left").select(
        "doc_id", "text_hash", "shingles",
        F.when(some, F.col("copies") - 1 + F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        (~some | (F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("text_hash").eqNullSafe(F.col("keeper")))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, columns and rows as they came.

    The rows that go are joined away; texts are compared again only where id and text repeat.
    """
    result = settle(docs.sparkSession, lambda: jaccard_join(docs, threshold), "jaccard")
    key = [F.col("doc_id").cast("long").alias("__j_id"), F.xxhash64(F.col("text").cast("string")).alias("__j_hash")]
    keyed = docs.select("*", *key)

    gone = result.where("not kept").select(F.col("doc_id").alias("__j_i"), F.col("text_hash").alias("__j_h")).distinct()
    again = result.where("kept and shingles > 0").groupBy(F.col("doc_id").alias("__j_i"), F.col("text_hash").alias("__j_h")).count().where("count > 1").drop("count")
    marks = gone.select("__j_i", "__j_h", F.lit(0).alias("__j_again")).union(again.select("__j_i", "__j_h", F.lit(1)))
    marked = keyed.join(marks, keyed["__j_id"].eqNullSafe(marks["__j_i"]) & (keyed["__j_hash"] == marks["__j_h"]), "left")
    once = marked.where("__j_again = 1").dropDuplicates(["__j_id", "__j_hash"])
    return marked.where("__j_again is null").unionByName(once).select(*docs.columns)
