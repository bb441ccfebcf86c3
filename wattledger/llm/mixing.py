"""Mixing sources to target weights.

The words of a source are one long sequence, cut into blocks of fixed length. Target weights give every source a number
of slots. Each output shard draws how many of its slots every source gets: multinomial counts, conditioned on the totals,
so that all shards together use exactly the slots there are. The slots of a source go through a pseudorandom permutation
of its block numbers, one per pass over the source, and blocks are joined to slots by number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.llm.positions import positions
from wattledger.staging import settle, stage

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK = 64
SHARD_SLOTS = 2048
WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: A source is repeated at most so many times.
PASSES = 2
SEED = 23
#: Sources whose statistics the driver plans with; a mixture is configured by source, so it is a short list.
MOST_SOURCES = 1_000_000


def targets(sizes: list[int], weights: list[float], share: float = SHARE, passes: int = PASSES) -> list[float]:
    """``share`` of all words by weight; a source stops at ``passes`` times its size and the excess goes to the rest."""
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / total > passes * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = float(passes * sizes[k])
            left -= out[k]
        open_ = [k for k in open_ if k not in set(over)]
    return out


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "little")


def shard_counts(slots: np.ndarray, shards: int, shard: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(slots before this shard, slots in it) of every source.

    Walks down a binary tree over the shards; at each node the left half draws its counts without replacement from the
    node's. So any shard finds its counts by itself, in steps of the logarithm, and all shards agree.
    """
    low, high = 0, shards
    before, here = np.zeros_like(slots), slots.copy()
    total = int(slots.sum())
    while high - low > 1:
        middle = (low + high) // 2
        want = total * middle // shards - total * low // shards
        rng = np.random.default_rng(_seed(seed, low, high))
        left = np.zeros_like(here)
        rest = int(here.sum())
        for k in range(len(here)):  # one source after another: a multivariate hypergeometric draw
            rest -= int(here[k])
            left[k] = _draw(rng, int(here[k]), rest, want - int(left[:k].sum()))
        if shard < middle:
            here, high = left, middle
        else:
            before, here, low = before + left, here - left, middle
    return before, here


def _draw(rng, good: int, bad: int, wanted: int) -> int:
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, wanted)) if wanted else 0
    share = good / (good + bad)  # beyond numpy's range: its normal limit, kept within the possible
    sd = (wanted * share * (1 - share) * (good + bad - wanted) / (good + bad - 1)) ** 0.5
    return int(min(max(round(rng.normal(wanted * share, sd)), wanted - bad, 0), good, wanted))


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: four Feistel rounds on the next even number of bits, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(_seed(key, r)) for r in range(4)]

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(32)
            f *= np.uint64(0xC4CEB9FE1A85EC53)
            left, right = right, left ^ ((f >> np.uint64(29)) & mask)
        return (left << np.uint64(half)) | right

    out = once(i.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def plan_sources(sizes: DataFrame, weights=WEIGHTS) -> pd.DataFrame:
    """``source, source_size, target, blocks, slots`` in code point order, null last, from ``source, source_size``."""
    rows = sizes.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r.source is None, r.source or ""))
    size = [int(r.source_size) for r in rows]
    target = targets(size, [weights[k % len(weights)] for k in range(len(rows))])
    blocks = [-(-s // BLOCK) for s in size]
    slots = [min(PASSES * b, round(t * b / s)) if s else 0 for s, t, b in zip(size, target, blocks)]
    return pd.DataFrame({"number": range(len(rows)), "source": [r.source for r in rows], "source_size": size, "target": target, "blocks": blocks, "slots": slots})


def draw_slots(spark, plan: pd.DataFrame, seed: int = SEED) -> DataFrame:
    """``shard, slot, number, pass, block``: every slot of the mix, its source, and the block it takes."""
    slots, blocks = plan["slots"].to_numpy(np.int64), plan["blocks"].to_numpy(np.int64)
    shards = max(1, -(-int(slots.sum()) // SHARD_SLOTS))
    shared = spark.sparkContext.broadcast((slots, blocks))

    def deal(batches):
        slots, blocks = shared.value
        for pdf in batches:
            for shard in pdf["id"]:
                before, here = shard_counts(slots, shards, int(shard), seed)
                number = np.repeat(np.arange(len(here)), here)
                j = np.concatenate([np.arange(b, b + h) for b, h in zip(before, here)]) if len(here) else np.zeros(0, np.int64)
                order = np.random.default_rng(_seed(seed, "order", int(shard))).permutation(len(j))
                number, j = number[order], j[order]
                turn = j // blocks[number]
                block = np.zeros(len(j), np.int64)
                for key in sorted(set(zip(number.tolist(), turn.tolist()))):
                    at = (number == key[0]) & (turn == key[1])
                    block[at] = permute(j[at] % blocks[key[0]], int(blocks[key[0]]), _seed(seed, *key))
                yield pd.DataFrame({"shard": np.int64(shard), "slot": np.arange(len(j)), "number": number, "pass": turn, "block": block})

    parts = min(shards, 4 * spark.sparkContext.defaultParallelism) if shards < 10_000 else shards // 64
    return spark.range(0, shards, 1, max(1, parts)).mapInPandas(deal, "shard long, slot long, number long, pass long, block long")


def pack(docs: DataFrame) -> tuple[DataFrame, pd.DataFrame]:
    """(rows, plan) of ``docs(row, doc_id, source, text)``: the rows with their number of words ``size``, the number of
    their source, its ``source_size`` and ``target``, and ``first``, the place of their first word in the source's
    sequence, which is in order of id, size and arrival. ``plan`` is that of ``plan_sources``."""
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).drop("text")
    placed = stage(positions(sized, ["source"], ["doc_id", "size"], "size", "first", "source_size"), "packed")
    plan = plan_sources(placed.groupBy("source").agg(F.max("source_size").alias("source_size")))
    numbers = docs.sparkSession.createDataFrame([(int(r.number), r.source, float(r.target)) for r in plan.itertuples()], "number int, _source string, target double")
    return placed.join(numbers, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), plan


def mix_rows(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``row, doc_id, source, size, source_size, target, pieces`` of ``docs(row, doc_id, source, text)``: what the mix
    takes of each row, as an array of ``(pass, shard, slot, from, to)`` over its words (null if nothing)."""
    rows, plan = pack(docs)
    # Staged, so that the planner knows its size: it grows with the corpus and must not be broadcast.
    slots = stage(draw_slots(docs.sparkSession, plan, seed), "slots")
    spread = rows.where("size > 0").select("row", "number", "first", "size", F.explode(F.sequence(
        F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("size") - 1) / BLOCK))).alias("block"))
    taken = spread.join(slots, ["number", "block"]).select("row", F.struct(
        F.col("pass"), "shard", "slot",
        F.greatest(F.col("block") * BLOCK - F.col("first"), F.lit(0)).alias("from"),
        F.least(F.col("block") * BLOCK + BLOCK - F.col("first"), F.col("size")).alias("to")).alias("piece"))
    by_row = taken.groupBy("row").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    return rows.join(by_row, "row", "left").select("row", "doc_id", "source", "size", "source_size", "target", "pieces")


def _inputs(docs: DataFrame, row) -> DataFrame:
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``row, doc_id, source, size, source_size, target, pieces``: see ``mix_rows``; ``row`` only tells rows apart.

    Only ``doc_id, text, source`` are read. Sizes are words (null and empty texts: 0, never taken). A null source is a
    source, last in order; null ids come first in their source; repeated rows are documents of their own; an empty
    table gives no rows. Blocks run across documents, so a long text is many blocks and a short one part of a block.

    Texts are only counted: what is shuffled is a narrow row per document and one per slot. Blocks meet slots by
    (source, block), which spreads a source with a third of all rows over all its blocks.
    """
    return mix_rows(_inputs(docs, F.monotonically_increasing_id()), seed)


def mix_report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: how many of its words the mix takes, repeats counted."""
    return mix_documents(docs, seed).select(
        "doc_id", "size", "source_size", "target",
        F.coalesce(F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, p: acc + p["to"] - p["from"]), F.lit(0)).cast("long").alias("taken"))


def _slicer(columns: list[str]):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")

    def cut(text: str, ranges: list[tuple[int, int]], size: int) -> str:
        merged: list[list[int]] = []
        for a, b in sorted(ranges):
            if merged and merged[-1][1] == a:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        if merged == [[0, size]]:
            return text
        spans = [m.span() for m in word.finditer(text)]
        return "\n".join(text[spans[a][0]:spans[b - 1][1]] for a, b in merged)

    def run(batches):
        for pdf in batches:
            keep, texts = [], []
            for k, (text, size, pieces) in enumerate(zip(pdf["text"], pdf["__m_size"], pdf["__m_pieces"])):
                turns: dict[int, list] = {}
                for p in pieces:
                    turns.setdefault(p["pass"], []).append((p["from"], p["to"]))
                for turn in sorted(turns):
                    keep.append(k)
                    texts.append(cut(text, turns[turn], size))
            out = pdf[columns].iloc[keep].astype({c: object for c in columns if pdf[c].dtype.name in ("str", "string")})
            out["text"] = texts
            if "n_chars" in columns:
                out["n_chars"] = [len(t) for t in texts]
            yield out
    return run


def mix_texts(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed corpus as documents: for each document and pass over its source, a row with the words the mix takes.

    The columns of ``docs`` stay; ``text`` holds the taken words as they stand in the text (the whole text if all are
    taken, else the taken stretches, a line each) and ``n_chars``, if there, its length. Documents of which nothing is
    taken have no row. The texts move once, to meet their pieces.
    """
    rows = stage(docs.withColumn("__m_row", F.monotonically_increasing_id()), "mixed")
    mixed = settle(docs.sparkSession, lambda: mix_rows(_inputs(rows, F.col("__m_row")), seed).where("pieces is not null").select(
        F.col("row").alias("__m_row"), F.col("size").alias("__m_size"), F.transform("pieces", lambda p: F.struct(p["pass"], p["from"], p["to"])).alias("__m_pieces")), "pieces")
    return rows.join(mixed, "__m_row").drop("__m_row").mapInPandas(_slicer(docs.columns), docs.schema)
