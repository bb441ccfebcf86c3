"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as its hashed embedding next to the summed embeddings of its hashed characters: byte trigrams, and prefixes
for the stems of inflected words. Windows of words overlap
and cover the whole text; a document scores as its worst window. Labels are of documents, so training alternates: score
all windows of the sample, then learn from each document's worst one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.llm.words import Words, chunks, hash_words

WORD_BUCKETS, CHAR_BUCKETS = 16_384, 16_384
PREFIXES = (4, 5, 6, 7, 8)
WORD_DIM = CHAR_DIM = HIDDEN = ATTENTION = 8
WINDOW, STRIDE = 64, 48
#: Bound of the training sample: so many labelled documents of either class, by hash of their id.
SAMPLE_PER_CLASS = 700
WARM_ROUNDS, ROUNDS, BATCH, RATE = 2, 6, 256, 0.02
#: A word or character bucket starts from how unlike its shares of toxic and clean documents are (in standard errors, if this many or
#: more) and is trained if so many documents of the sample have it; the other word buckets stay at zero.
LEAST_Z, LEAST_DOCUMENTS = 4.0, 5
#: Weight of an error on a toxic document against one on a clean document when the cut is set.
TOXIC_WEIGHT = 0.3
SEED = 17


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Windows:
    """Overlapping windows of a chunk as indices into its distinct words; -1 past the end of a window."""

    def __init__(self, words: Words):
        uniq, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        self.word_ids = (uniq % np.uint64(WORD_BUCKETS)).astype(np.int64)
        begin, end = words.begin[first], words.end[first]
        size = end - begin
        slides = np.maximum(size - 2, 1)
        grams = slides + sum((size >= k).astype(np.int64) for k in PREFIXES)
        self.gram_at = np.cumsum(grams) - grams
        local = np.arange(grams.sum()) - np.repeat(self.gram_at, grams)
        extra = local - np.repeat(slides, grams)  # 0 and up: the prefixes
        start = np.repeat(begin, grams) + np.where(extra < 0, local, 0)
        stop = np.where(extra < 0, np.minimum(start + 3, np.repeat(end, grams)), start + PREFIXES[0] + np.maximum(extra, 0))
        salt = np.where(extra < 0, np.uint64(0), np.uint64(0x9E3779B9))
        self.gram_ids = ((words.spans(start, stop) ^ salt) % np.uint64(CHAR_BUCKETS)).astype(np.int64)
        self.gram_n = grams
        self.inverse = inverse
        counts = np.diff(words.offsets)
        n = np.where(counts > 0, np.maximum(0, -(-(counts - WINDOW) // STRIDE)) + 1, 0)
        self.text = np.repeat(np.arange(len(counts)), n)
        start = words.offsets[self.text] + (np.arange(len(self.text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
        self.length = np.minimum(WINDOW, words.offsets[self.text + 1] - start)
        spot = start[:, None] + np.arange(WINDOW)
        inside = np.arange(WINDOW) < self.length[:, None]
        self.ids = np.where(inside, inverse[np.minimum(spot, max(len(inverse) - 1, 0))], -1).astype(np.int32) if len(inverse) else np.zeros((0, WINDOW), np.int32)


    def subset(self, rows: np.ndarray) -> Windows:
        """The given windows, with only the words they have."""
        out = object.__new__(Windows)
        ids = self.ids[rows]
        used, place = np.unique(ids[ids >= 0], return_inverse=True)
        out.ids = np.full_like(ids, -1)
        out.ids[ids >= 0] = place
        out.word_ids, out.gram_n = self.word_ids[used], self.gram_n[used]
        out.gram_at = np.cumsum(out.gram_n) - out.gram_n
        out.gram_ids = self.gram_ids[np.repeat(self.gram_at[used] - out.gram_at, out.gram_n) + np.arange(out.gram_n.sum())]
        return out


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)

        def draw(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        self.p = {
            "word": np.zeros((WORD_BUCKETS, WORD_DIM), np.float32), "char": draw(CHAR_BUCKETS, CHAR_DIM, scale=0.1),
            "x": draw(d, 6 * h, scale=d ** -0.5), "xb": np.zeros(6 * h, np.float32),
            "f": draw(h, 3 * h, scale=h ** -0.5), "b": draw(h, 3 * h, scale=h ** -0.5),
            "a": draw(2 * h, ATTENTION, scale=(2 * h) ** -0.5), "v": draw(ATTENTION, scale=0.5),
            "o": draw(2 * h, scale=0.3), "ob": np.zeros(1, np.float32),
        }

    def inputs(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(features, gate inputs) of the distinct words; the last row is padding."""
        chars = np.add.reduceat(self.p["char"][w.gram_ids], w.gram_at, axis=0) / np.sqrt(w.gram_n, dtype=np.float32)[:, None]
        x = np.concatenate([self.p["word"][w.word_ids], chars], axis=1)
        g = x @ self.p["x"] + self.p["xb"]
        return x, np.concatenate([g, np.zeros((1, g.shape[1]), np.float32)])

    def _direction(self, gates, ids, u, keep):
        n, steps, h = len(ids), ids.shape[1], HIDDEN
        gates = np.ascontiguousarray(gates)
        state = np.zeros((n, h), np.float32)
        out = np.empty((steps, n, h), np.float32)
        trace = []
        for t in range(steps):
            at = ids[:, t]
            g = gates[at]
            hu = state @ u
            zr = np.tanh(0.5 * (g[:, :2 * h] + hu[:, :2 * h]))
            zr += 1
            zr *= 0.5
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(g[:, 2 * h:] + r * hu[:, 2 * h:])
            new = c + z * (state - c)
            if keep:
                trace.append((state, z, r, c, hu[:, 2 * h:]))
            state = np.where(at[:, None] >= 0, new, state) if at.min() < 0 else new
            out[t] = state
        return out.transpose(1, 0, 2), trace

    def forward(self, gates: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of windows. Past its end a window keeps its state and gets no attention."""
        h = HIDDEN
        mask = ids >= 0
        f, tf = self._direction(gates[:, :3 * h], ids, self.p["f"], keep)
        b, tb = self._direction(gates[:, 3 * h:], ids[:, ::-1], self.p["b"], keep)
        hs = np.concatenate([f, b[:, ::-1]], axis=2)
        t = np.tanh(hs @ self.p["a"])
        e = np.where(mask, t @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        alpha = e / e.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", alpha, hs)
        logit = pooled @ self.p["o"] + self.p["ob"][0]
        return logit, (mask, hs, t, alpha, pooled, tf, tb)

    def _back(self, dout, u, mask, trace):
        h, n = HIDDEN, len(dout)
        du, dg = np.zeros_like(u), np.zeros((n, dout.shape[1], 3 * h), np.float32)
        ds = np.zeros((n, h), np.float32)
        for t in reversed(range(dout.shape[1])):
            state, z, r, c, hn = trace[t]
            ds = ds + dout[:, t]
            m = mask[:, t, None]
            d = np.where(m, ds, 0)
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (state - c) * z * (1 - z)
            dr = dc * hn * r * (1 - r)
            gate = np.concatenate([dz, dr, dc], axis=1)
            dg[:, t] = gate
            hu = np.concatenate([dz, dr, dc * r], axis=1)
            du += state.T @ hu
            ds = np.where(m, d * z + hu @ u.T, ds)
        return du, dg

    def gradients(self, w: Windows, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss over all windows of ``w``."""
        h, p, ids = HIDDEN, self.p, w.ids
        x, gates = self.inputs(w)
        logit, (mask, hs, t, alpha, pooled, tf, tb) = self.forward(gates, ids, True)
        d = ((_sigmoid(logit) - label) * weight / len(ids)).astype(np.float32)
        grad = {"o": d @ pooled, "ob": d.sum(keepdims=True)}
        dpool = d[:, None] * p["o"]
        dhs = alpha[:, :, None] * dpool[:, None]
        da = np.einsum("nh,nth->nt", dpool, hs)
        de = alpha * (da - (alpha * da).sum(axis=1, keepdims=True))
        grad["v"] = np.einsum("nt,nta->a", de, t)
        dt = de[:, :, None] * p["v"] * (1 - t * t)
        grad["a"] = np.einsum("nth,nta->ha", hs, dt)
        dhs = dhs + dt @ p["a"].T
        grad["f"], gf = self._back(dhs[:, :, :h], p["f"], mask, tf)
        grad["b"], gb = self._back(dhs[:, ::-1, h:], p["b"], mask[:, ::-1], tb)
        dg = np.zeros((len(x), 6 * h), np.float32)
        np.add.at(dg, ids[mask], np.concatenate([gf, gb[:, ::-1]], axis=2)[mask])
        grad["x"], grad["xb"] = x.T @ dg, dg.sum(axis=0)
        dx = dg @ p["x"].T
        grad["word"], grad["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(grad["word"], w.word_ids, dx[:, :WORD_DIM])
        np.add.at(grad["char"], w.gram_ids, np.repeat(dx[:, WORD_DIM:] / np.sqrt(w.gram_n, dtype=np.float32)[:, None], w.gram_n, axis=0))
        return grad

    def logits(self, w: Windows, batch: int = 1024) -> np.ndarray:
        if not len(w.ids):
            return np.zeros(0)
        _, gates = self.inputs(w)
        return np.concatenate([self.forward(gates, w.ids[a:a + batch])[0] for a in range(0, len(w.ids), batch)])

    def start(self, words: Words, w: Windows, label: np.ndarray) -> dict[str, np.ndarray]:
        """Set the embeddings' first value from document counts; the buckets to train."""
        text = np.repeat(np.arange(len(label)), np.diff(words.offsets))
        n = [max(float((label == v).sum()), 1.0) for v in (1, 0)]
        gram_of = np.repeat(np.arange(len(w.gram_n)), w.gram_n)
        trained = {}
        for name, buckets in (("word", WORD_BUCKETS), ("char", CHAR_BUCKETS)):
            counts = np.zeros((2, buckets))
            for v in range(2):
                for t in np.flatnonzero(label == 1 - v):
                    own = np.zeros(len(w.word_ids), bool)
                    own[w.inverse[words.offsets[t]:words.offsets[t + 1]]] = True
                    counts[v, np.unique(w.word_ids[own] if name == "word" else w.gram_ids[own[gram_of]])] += 1
            share = (counts.sum(axis=0) + 1) / (n[0] + n[1] + 2)
            z = (counts[0] / n[0] - counts[1] / n[1]) / np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]))
            often = counts.sum(axis=0) >= LEAST_DOCUMENTS
            self.p[name][:, 0] = np.where((np.abs(z) >= LEAST_Z) & often, np.clip(z / LEAST_Z, -3, 3), 0)
            trained[name] = often[:, None].astype(np.float32)
            self.p[name] *= trained[name]
        return trained

    def score(self, texts: list[str]) -> np.ndarray:
        """Worst window of each text as a probability; 0 without a word."""
        out = np.zeros(len(texts))
        for first, part in chunks(texts):
            w = Windows(hash_words(part, letters=True))
            np.maximum.at(out, first + w.text, _sigmoid(self.logits(w).astype(np.float64)))
        return out


def train(texts: list[str], labels: list[int], seed: int = SEED) -> Network:
    """Fit on documents. Same rows in the same order give the same network; without a toxic row it scores low."""
    net, rng = Network(seed), np.random.default_rng(seed)
    words = hash_words(texts, letters=True)
    w = Windows(words)
    label = np.asarray(labels, np.float32)
    if not len(w.ids) or not label.any():
        net.p["ob"][0] = -5
        return net
    share = min(max(float(label[np.unique(w.text)].mean()), 0.01), 0.99)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, trained = 0, net.start(words, w, label)
    for turn in range(WARM_ROUNDS + ROUNDS):
        noise = rng.random(len(w.ids))
        if turn < WARM_ROUNDS:  # two windows at random, whichever the document's label
            order = np.lexsort((noise, w.text))
        else:  # the worst window of each document, and another one of clean documents
            order = np.lexsort((-net.logits(w), w.text))
        place = np.arange(len(order)) - np.searchsorted(w.text[order], w.text[order])
        clean = label[w.text[order]] == 0
        pick = order[(place < 1) | ((place < 2) & clean) | ((place < 3) & (turn < WARM_ROUNDS))]
        rng.shuffle(pick)
        for a in range(0, len(pick), BATCH):
            rows = pick[a:a + BATCH]
            y = label[w.text[rows]]
            grad = net.gradients(w.subset(rows), y, np.where(y == 1, 0.5 / share, 0.5 / (1 - share)))
            step += 1
            for k, v in net.p.items():
                g = grad[k] * trained[k] if k in trained else grad[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                v -= RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)
    # Where a document counts as toxic: the middle of the range of cuts with the fewest errors on the sample.
    worst = np.full(len(label), -np.inf)
    np.maximum.at(worst, w.text, net.logits(w))
    cuts = np.sort(worst[np.isfinite(worst)])
    errors = np.array([(worst[label == 1] < c).sum() * TOXIC_WEIGHT + (worst[label == 0] >= c).sum() * (1 - TOXIC_WEIGHT) for c in cuts])
    best = int(np.argmin(errors))
    net.p["ob"] -= np.float32((cuts[best] + cuts[max(best - 1, 0)]) / 2)
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Network:
    """Network fitted on at most ``per_class`` labelled documents of either class, chosen by hash of their id.

    Rows whose crc32 of the id modulo 5 is 0 are held out. Null labels, ids and texts are left out. Of several labels
    of an id the toxic one counts, of several texts the least.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "toxic in (0, 1) and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for value in (1, 0):
        part = usable.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    # Both bounded by per_class: the ids are broadcast, their texts come to the driver.
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = base.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return train([r.text for r in rows], [r.toxic for r in rows])


def with_score(docs: DataFrame, network: Network, column: str = "score") -> DataFrame:
    """``docs`` and the score of each whole text. The network has a fixed size and is broadcast; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(list(texts)))

    return docs.withColumn(column, score(F.col("text").cast("string")))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Only ``doc_id`` and ``text`` of ``docs`` and ``doc_id, toxic`` of ``labels`` are read, and only the text makes the
    score. Null and empty texts score 0; repeated rows score alike; an id of null is not held out; an empty table gives
    no rows, and without labels every score is low.
    """
    remainder = F.crc32(F.col("doc_id").cast("long").cast("string")) % 5
    return with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels)).select(
        "doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that score 0.5 or more, columns and rows as they came."""
    return with_score(docs, fit(docs, labels), "__t_score").where("__t_score < 0.5").drop("__t_score")
