"""Benchmark decontamination: a BM25 index of test items, searched by every passage of the training texts.

Items are cut into segments, eight to a block. The index holds, per term, its largest score in the whole index, in each
block and in each segment, every score divided by what the segment's own words reach. A passage is dropped while the
sum of its terms' largest scores stays below the threshold (the pivot test), then block by block (the block maxima),
and only the segments of blocks that are left are scored. So all segments at or above the threshold are found. Each is
verified: the item's question and its answer must both reappear around the passage, in runs of three words or, if a part
is shorter, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.llm.words import chunks, hash_words, runs
from wattledger.staging import stage

K1, B = 1.2, 0.75
PASSAGE, STRIDE = 64, 32
SEGMENT = 48
BLOCK = 8
#: Share of a segment's own score that a passage must reach.
SCORE = 0.5
#: Share of the question's and of the answer's word trigrams that must reappear; a shorter part must reappear whole.
OVERLAP = 0.6
GRAM = 3
#: Items of fewer words are no evidence and are not searched.
LEAST_WORDS = 5
#: Segments of one index; a larger benchmark gets several, and every passage is run against each.
INDEX_SEGMENTS = 1024
#: Indexes broadcast for one pass over the documents; a larger benchmark takes several passes.
AT_ONCE = 4


def split_item(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Words of (question, answer): the last sentence is the answer; a single sentence is cut after two thirds of its
    words. What is counted are words of letters and digits, so that no part of an item of two words is empty."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    if len(parts) > 1:
        question, answer = (hash_words([p], letters=True).hashes for p in (" ".join(parts[:-1]), parts[-1]))
        if min(len(question), len(answer)) >= GRAM:
            return question, answer
    words = hash_words([text], letters=True).hashes
    cut = len(words) - max(1, len(words) // 3)
    return words[:cut], words[cut:]


def _grams(part: np.ndarray) -> tuple[int, np.ndarray]:
    """(words of a run, runs) that are looked for: a part of fewer than ``GRAM`` words is one run of its own length."""
    k = max(1, min(GRAM, len(part)))
    return k, np.unique(runs(part, k))


class Index:
    """Scores of one set of segments and the items they come from."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = items
        self.parts = [tuple(_grams(p) for p in split_item(t)) for _, t in items]
        segments, self.owner, self.start, self.length = [], [], [], []
        for k, (_, text) in enumerate(items):
            h = hash_words([text], letters=True).hashes
            pieces = max(1, -(-len(h) // SEGMENT))
            for a in (len(h) * np.arange(pieces + 1) // pieces)[:-1]:
                size = -(-len(h) // pieces)
                segments.append(h[a:a + size])
                self.owner.append(k)
                self.start.append(int(a))
                self.length.append(len(h))
        self.terms = np.unique(np.concatenate(segments))
        n = len(segments)
        tf = np.zeros((len(self.terms) + 1, -(-n // BLOCK) * BLOCK), np.float32)
        for k, s in enumerate(segments):
            np.add.at(tf[:, k], np.searchsorted(self.terms, s), 1)
        df = (tf > 0).sum(axis=1)
        length = tf.sum(axis=0)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(length[:n].mean(), 1))
        score = (idf[:, None] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
        score[-1] = 0  # words outside the index
        score /= np.maximum(score.sum(axis=0), 1e-9)
        self.by_segment = score
        self.by_block = score.reshape(len(score), -1, BLOCK).max(axis=2)
        self.largest = self.by_block.max(axis=1)
        self.segments = n

    def search(self, hashes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(text, first word, segment, score) of every passage and segment at or above the threshold."""
        unknown = len(self.terms)
        term = np.searchsorted(self.terms, hashes)
        term[term == unknown] = 0
        term = np.where(self.terms[term] == hashes, term, unknown).astype(np.int32)
        counts = np.diff(offsets)
        windows = np.where(counts > 0, np.maximum(0, -(-(counts - PASSAGE) // STRIDE)) + 1, 0)
        text = np.repeat(np.arange(len(counts)), windows)
        local = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = offsets[text] + local * STRIDE
        stop = np.minimum(start + PASSAGE, offsets[text + 1])
        # The pivot test on sums over repeated words, an upper bound: one difference of a running sum per passage.
        running = np.concatenate([[0.0], np.cumsum(self.largest[term], dtype=np.float64)])
        left = np.flatnonzero(running[stop] - running[start] >= SCORE - 1e-4)
        order = np.argsort(term, kind="stable")
        previous = np.full(len(term), -1, np.int64)
        same = term[order][1:] == term[order][:-1]
        previous[order[1:][same]] = order[:-1][same]
        for at in range(0, len(left), 1024):
            w = left[at:at + 1024]
            spot = start[w][:, None] + np.arange(PASSAGE)
            inside = spot < stop[w][:, None]
            spot = np.minimum(spot, len(term) - 1)
            ids = np.where(inside & (previous[spot] < start[w][:, None]), term[spot], unknown)
            bound = self.largest[ids].sum(axis=1) >= SCORE - 1e-4
            w, ids = w[bound], ids[bound]
            blocks = np.zeros((len(w), self.by_block.shape[1]), np.float32)
            for k in range(PASSAGE):
                blocks += self.by_block[ids[:, k]]
            for i, b in zip(*np.nonzero(blocks >= SCORE - 1e-4)):
                score = self.by_segment[ids[i], b * BLOCK:(b + 1) * BLOCK].sum(axis=0, dtype=np.float64)
                for s in np.flatnonzero(score >= SCORE):
                    yield int(text[w[i]]), int(start[w[i]]), int(b * BLOCK + s), float(score[s])


def build_indexes(items: Iterable[tuple[int, str]]) -> Iterator[Index]:
    """Indexes of at most ``INDEX_SEGMENTS`` segments (or one item); items without ``LEAST_WORDS`` words are left out."""
    part, segments = [], 0
    for item, text in items:
        n = len(hash_words([text], letters=True).hashes) if text else 0
        if n < LEAST_WORDS:
            continue
        need = -(-n // SEGMENT)
        if part and segments + need > INDEX_SEGMENTS:
            yield Index(part)
            part, segments = [], 0
        part.append((item, text))
        segments += need
    if part:
        yield Index(part)


def _overlap(part: np.ndarray, around: np.ndarray) -> float:
    return float(np.isin(part, around, assume_unique=True).mean()) if len(part) else 0.0


def _searcher(shared):
    def run(batches):
        for batch in batches:
            for first, texts in chunks(batch["text"]):
                words = hash_words(texts, letters=True)
                best: dict[tuple[int, int], tuple] = {}
                for index in shared.value:
                    for doc, start, segment, score in index.search(words.hashes, words.offsets):
                        k = index.owner[segment]
                        item = index.items[k][0]
                        reach = index.length[segment] + SEGMENT
                        lo = max(words.offsets[doc], start - index.start[segment] - reach)
                        hi = min(words.offsets[doc + 1], start + PASSAGE + reach)
                        around = {n: np.unique(runs(words.hashes[lo:hi], n)) for n in {n for n, _ in index.parts[k]}}
                        question, answer = (_overlap(p, around[n]) for n, p in index.parts[k])
                        row = (min(question, answer) >= OVERLAP, score, -start, question, answer)
                        if row > best.get((doc, item), (False, -1.0)):
                            best[doc, item] = row
                if best:
                    keys = list(best)
                    ids = batch["doc_id"].to_numpy()
                    hashes = batch["text_hash"].to_numpy()
                    yield pd.DataFrame({
                        "doc_id": pd.array([None if pd.isna(ids[first + d]) else int(ids[first + d]) for d, _ in keys], "Int64"),
                        "text_hash": [int(hashes[first + d]) for d, _ in keys],
                        "item_id": pd.array([i for _, i in keys], "Int64"),
                        "start_word": [int(-best[x][2] - words.offsets[x[0]]) for x in keys],
                        "score": [best[x][1] for x in keys],
                        "question_overlap": [best[x][3] for x in keys],
                        "answer_overlap": [best[x][4] for x in keys],
                        "contaminated": [best[x][0] for x in keys],
                    })
    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, text_hash, item_id, start_word, score, question_overlap, answer_overlap, contaminated``: one row per
    document and item that some passage of the document retrieves, with its best passage.

    Every overlapping passage of every text is a query. Words are runs of letters and digits, lower-cased. Only
    ``doc_id``, ``text`` of ``docs`` and ``item_id``, ``text`` of ``benchmark`` are read. Null and empty texts retrieve
    nothing; null, empty and very short items are not searched; an empty table gives no rows. Ties: the first passage.
    Repeated rows each give their rows. An item is named by ``item_id`` (null allowed); repeated items count once.

    The benchmark is read to the driver item by item. What is broadcast is bounded by ``AT_ONCE`` indexes of
    ``INDEX_SEGMENTS`` segments; beyond it, each further batch of indexes is another pass over the documents, written
    before the next. There is no shuffle. Texts of one item that fall into different batches give a row each.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))

    def search(indexes):
        shared = spark.sparkContext.broadcast(list(indexes))
        return shared, base.mapInPandas(_searcher(shared), "doc_id long, text_hash long, item_id long, start_word long, score double, question_overlap double, answer_overlap double, contaminated boolean")

    batches = batched(build_indexes(tuple(r) for r in items.orderBy("item_id", "text").toLocalIterator()), AT_ONCE)
    _, found = search(next(batches, ()))
    for indexes in batches:
        shared, more = search(indexes)
        found = found.union(stage(more, "contaminated"))
        shared.unpersist()
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones, columns and rows as they came. Documents are told by id and text."""
    bad = find_contamination(docs, benchmark).where("contaminated").select(
        F.col("doc_id").alias("__d_id"), F.col("text_hash").alias("__d_hash")).distinct()
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("__d_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__d_hash"))
    return docs.join(bad, match, "left_anti")
