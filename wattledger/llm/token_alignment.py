"""Alignment of two tokenizers over the same texts.

Both encode a text without special tokens; their tokens then cover the same bytes (a space and the text). A byte offset
at which a token of both ends is a cut. The cuts are found by divide and conquer: of an interval, a common end near the
middle is located by bisecting the other tokenizer's ends; both halves go on by themselves, and an interval without a
common end is a group. All intervals of a level, over all texts of a chunk, are handled by a few array operations.

Texts that are null, empty, or whose joined token bytes differ from space and text have no tokens. Long texts are chunks
of their own and never cut; repeated rows are rows of their own; a null id stays null; other columns are not read. An
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.llm.words import chunks
from wattledger.staging import stage

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Links that a task collects before it adds up equal pairs of ids.
LINKS_HELD = 1 << 20
#: Pairs of ids whose counts are given to every task (17 bytes each); the others are joined by shuffle.
HEAD_PAIRS = 1 << 20

# Fixed value: the pattern by which the byte-level vocabulary was trained.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern recurses over such runs; their texts take the slower encoder.
_LONG_BLANK = re.compile(r"\s{1000}")


@dataclass
class Vocabulary:
    """Bytes of every id, in one buffer, and what makes the encoder: tasks that only need the bytes do not load it."""

    encoder: Callable
    lengths: np.ndarray
    starts: np.ndarray
    buffer: np.ndarray

    @property
    def id_type(self) -> np.dtype:
        return np.dtype("<u2" if len(self.lengths) <= 1 << 16 else "<u4")

    @cached_property
    def encode(self) -> Callable[[list[str]], list[list[int]]]:
        return self.encoder()

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        skip = np.cumsum(n) - n
        return self.buffer[np.repeat(self.starts[ids] - skip, n) + np.arange(int(n.sum()))]


def _vocabulary(encoder: Callable, tokens: list[bytes]) -> Vocabulary:
    lengths = np.array([len(t) for t in tokens], np.int64)
    return Vocabulary(encoder, lengths, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(tokens), np.uint8))


def _byte_symbols() -> dict[str, int]:
    """Bytes that print stand for themselves in a byte-level vocabulary, the others for code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> Vocabulary:
    """Byte-level BPE. Its merges are in the order of the ids (checked), so merging by id gives the same tokens."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    symbol = _byte_symbols()
    ids = model["model"]["vocab"]
    made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])):
        raise ValueError(f"{path}: merges are not in the order of ids")
    ranks = {bytes(symbol[c] for c in token): i for token, i in ids.items()}
    tokens = [b""] * (max([*ranks.values(), *(t["id"] for t in model["added_tokens"])]) + 1)
    for token, i in ranks.items():
        tokens[i] = token

    def encoder():
        import tiktoken

        fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [_slow_byte_bpe(path)(t) if _LONG_BLANK.search(t) else fast.encode_ordinary(" " + t) for t in texts]

    return _vocabulary(encoder, tokens)


@lru_cache(maxsize=4)
def _slow_byte_bpe(path: str) -> Callable[[str], list[int]]:
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return lambda text: slow.encode(" " + text, add_special_tokens=False).ids


@lru_cache(maxsize=4)
def piece_bpe(path: str) -> Vocabulary:
    """Pieces with byte fallback; the encoder itself adds the space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def content(i: int) -> bytes:
        if model.is_control(i) or model.is_unknown(i):
            return b""
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return _vocabulary(lambda: lambda texts: model.encode(texts, num_threads=1), [content(i) for i in range(model.get_piece_size())])


def common_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into ``a_ends`` and ``b_ends`` of the common ends, in order.

    Ends increase over the whole chunk. Text ``k`` has the tokens ``a_at[k]:a_at[k + 1]`` and ``b_at[k]:b_at[k + 1]``; its
    last ends are common. Every end is looked up once at most: what lies between the middle of an interval and the cut
    found is known to hold none, and is left out of the halves.
    """
    some = np.flatnonzero(a_at[1:] > a_at[:-1])
    found_a, found_b = [a_at[some + 1] - 1], [b_at[some + 1] - 1]
    # Bytes of the interval, and the ends of A that may still be cuts in it.
    first = np.concatenate([[0], a_ends])[a_at[some]]
    last = a_ends[a_at[some + 1] - 1]
    low, high = a_at[some], a_at[some + 1] - 1
    while True:
        open_ = low < high
        first, last, low, high = first[open_], last[open_], low[open_], high[open_]
        if not len(low):
            break
        right = np.clip(np.searchsorted(a_ends, (first + last) // 2), low, high - 1)
        left = right - 1
        cut_b = np.searchsorted(b_ends, a_ends[right])
        hit = b_ends[cut_b] == a_ends[right]
        cut_a = np.where(hit, right, -1)
        todo = np.flatnonzero(~hit)
        right[todo] += 1
        while len(todo):
            for at, step in ((left, -1), (right, 1)):
                here = todo[(at[todo] < high[todo]) & (at[todo] >= low[todo])]
                ends = a_ends[at[here]]
                b = np.searchsorted(b_ends, ends)
                hit = b_ends[b] == ends
                cut_a[here[hit]], cut_b[here[hit]] = at[here[hit]], b[hit]
                at[here[~hit]] += step
                todo = todo[cut_a[todo] < 0]
            todo = todo[(right[todo] < high[todo]) | (left[todo] >= low[todo])]
        cut = cut_a >= 0
        a, at = cut_a[cut], a_ends[cut_a[cut]]
        found_a.append(a)
        found_b.append(cut_b[cut])
        # The looked-up ends are those between ``left`` and ``right``; the cut is one of the two.
        first, last = np.concatenate([first[cut], at]), np.concatenate([at, last[cut]])
        low, high = (np.concatenate([low[cut], np.maximum(right[cut], a + 1)]),
                     np.concatenate([np.minimum(left[cut] + 1, a), high[cut]]))
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def _encoded(vocabulary: Vocabulary, texts: list[str], whole: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, their offsets, and which texts the joined bytes give back."""
    parts = vocabulary.encode(texts) if texts else []
    sizes = np.array([len(p) for p in parts], np.int64)
    ids = np.fromiter(chain.from_iterable(parts), np.int64, int(sizes.sum()))
    at = np.concatenate([[0], np.cumsum(sizes)])
    data = vocabulary.joined(ids)
    ends = np.concatenate([[0], np.cumsum(vocabulary.lengths[ids])])[at]
    good = np.array([data[s:e].tobytes() == w for s, e, w in zip(ends[:-1], ends[1:], whole)], bool)
    return ids, at, good


def _keep(ids: np.ndarray, at: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(at)
    return ids[np.repeat(good, sizes)], np.concatenate([[0], np.cumsum(np.where(good, sizes, 0))])


def _align_chunk(texts: list[str], a: Vocabulary, b: Vocabulary):
    """Ids and offsets of both tokenizers, and the numbers of tokens in each group."""
    whole = [(" " + t).encode() if t else b"" for t in texts]
    a_ids, a_at, a_good = _encoded(a, texts, whole)
    b_ids, b_at, b_good = _encoded(b, texts, whole)
    good = a_good & b_good & np.array([bool(t) for t in texts], bool)
    (a_ids, a_at), (b_ids, b_at) = _keep(a_ids, a_at, good), _keep(b_ids, b_at, good)
    a_cut, b_cut = common_cuts(np.cumsum(a.lengths[a_ids]), np.cumsum(b.lengths[b_ids]), a_at, b_at)
    g_at = np.searchsorted(a_cut, a_at)
    return a_ids, a_at, b_ids, b_at, np.diff(a_cut, prepend=-1), np.diff(b_cut, prepend=-1), g_at


def _lists(values: np.ndarray, at: np.ndarray, dtype: np.dtype) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))


def _packed(values: np.ndarray, at: np.ndarray, dtype: np.dtype) -> pa.Array:
    """Each row's numbers as bytes: a reader holds many rows at once, and nested columns cost it several times as much."""
    offsets, data = (at * dtype.itemsize).astype(np.int32), values.astype(dtype)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(batch, name: str, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    return np.frombuffer(data.tobytes(), dtype).astype(np.int64), (at - at[0]) // dtype.itemsize


COUNT = np.dtype("<u4")
ALIGNED = ["a_ids", "b_ids", "a_in_group", "b_in_group"]


def _align(docs: DataFrame, a_path: str, b_path: str, column: Callable, kind: str) -> DataFrame:
    def run(batches):
        a, b = byte_bpe(a_path), piece_bpe(b_path)
        for batch in batches:
            for first, texts in chunks(batch.column("text").to_pylist()):
                a_ids, a_at, b_ids, b_at, a_in, b_in, g_at = _align_chunk(texts, a, b)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), column(a_ids, a_at, a.id_type), column(b_ids, b_at, b.id_type),
                     column(a_in, g_at, COUNT), column(b_in, g_at, COUNT)], ["doc_id", *ALIGNED])

    schema = "doc_id long, " + ", ".join(f"{c} {kind}" for c in ALIGNED)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def align_tokens(docs: DataFrame, a_path: str = f"{FOLDER}/{BYTE_BPE}", b_path: str = f"{FOLDER}/{PIECE_BPE}") -> DataFrame:
    """``doc_id, a_ids, b_ids, a_in_group, b_in_group``: the ids of both tokenizers in order, and for each group the number
    of tokens of either, as arrays.

    One row per row of ``docs(doc_id, text)``; no shuffle.
    """
    return _align(docs, a_path, b_path, _lists, "array<int>")


def token_links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the A and B token of every link, in order.

    No token ends inside the overlap of two tokens, so a link is a stretch between neighbouring ends of either kind.
    """
    size = int(a_ends[-1]) + 1 if len(a_ends) else 0
    a_ends_at, b_ends_at = np.zeros(size, np.int32), np.zeros(size, np.int32)
    a_ends_at[a_ends], b_ends_at[b_ends] = 1, 1
    ends = np.flatnonzero(a_ends_at | b_ends_at)
    return np.cumsum(a_ends_at)[ends - 1], np.cumsum(b_ends_at)[ends - 1]


def _slices(batch, limit: int = 1 << 18):
    """Parts of a batch with about ``limit`` bytes of ids, or one longer row."""
    column = batch.column("a_ids")
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    first = 0
    while first < batch.num_rows:
        last = max(int(np.searchsorted(at, at[first] + limit, "right")) - 1, first + 1)
        yield batch.slice(first, last - first)
        first = last


def _codes(batch, a: Vocabulary, b: Vocabulary):
    """Links of a batch: id pairs as ``a * ids of B + b``, and the offsets by row."""
    a_ids, a_at = _unpacked(batch, "a_ids", a.id_type)
    b_ids, b_at = _unpacked(batch, "b_ids", b.id_type)
    a_ends, b_ends = np.cumsum(a.lengths[a_ids]), np.cumsum(b.lengths[b_ids])
    i, j = token_links(a_ends, b_ends)
    return a_ids[i] * len(b.lengths) + b_ids[j], np.searchsorted(i, a_at), (a_ids, a_at), (b_ids, b_at)


def count_pairs(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``pair, n`` of rows with packed ids: how many links hold each pair of ids. Equal pairs are added up in the task before the shuffle."""
    def run(batches):
        a, b = byte_bpe(a_path), piece_bpe(b_path)
        held: list[np.ndarray] = []

        def flush():
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            for part in _slices(batch):
                held.append(_codes(part, a, b)[0])
                if sum(map(len, held)) >= LINKS_HELD:
                    yield flush()
        if held:
            yield flush()

    found = aligned.select("a_ids", "b_ids").mapInArrow(run, "pair long, n long")
    return found.groupBy("pair").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=4)
def _decimals(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all ids below ``limit``, left-justified with one byte to spare, and their lengths."""
    size = np.array([len(str(i)) for i in range(limit)], np.int64)
    digits = np.array([f"{i:<{size.max() + 1}}".encode() for i in range(limit)]).view(np.uint8)
    return digits.reshape(limit, -1), size


def group_texts(a_ids, a_in, b_ids, b_in, g_at) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of every row: the ids of its groups in order."""
    comma, bar, semicolon = b",|;"
    g = np.arange(len(a_in))
    a_after, b_after = np.full(len(a_ids), comma, np.uint8), np.full(len(b_ids), comma, np.uint8)
    a_after[np.cumsum(a_in) - 1], b_after[np.cumsum(b_in) - 1] = bar, semicolon
    b_before = np.cumsum(b_in) - b_in
    a_place = np.arange(len(a_ids)) + np.repeat(b_before, a_in)
    b_place = np.arange(len(b_ids)) + np.repeat(np.cumsum(a_in), b_in)
    ids, after = np.empty(len(a_ids) + len(b_ids), np.int64), np.empty(len(a_ids) + len(b_ids), np.uint8)
    ids[a_place], ids[b_place], after[a_place], after[b_place] = a_ids, b_ids, a_after, b_after
    table, sizes = _decimals(1 << int(ids.max(initial=0)).bit_length())
    digits, size = table[ids], sizes[ids]
    digits[np.arange(len(ids)), size] = after
    size = size + 1
    data = digits[np.arange(digits.shape[1]) < size[:, None]]
    tokens = np.concatenate([[0], np.cumsum(a_in + b_in)])[g_at]
    at = np.concatenate([[0], np.cumsum(size)])[tokens]
    return [data[s:max(e - 1, s)].tobytes() for s, e in zip(at[:-1], at[1:])]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


SCORED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rest array<struct<pair:long,n:long>>"


def alignment_report(docs: DataFrame, a_path: str = f"{FOLDER}/{BYTE_BPE}", b_path: str = f"{FOLDER}/{PIECE_BPE}", head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """Per document: tokens, groups, links, those whose pair is the most frequent of its B id, the sum of the pairs'
    counts, and a digest of the groups.

    Counts are over all documents. The most frequent pairs (``head_pairs`` at most) and one number per B id are given to
    every task; links of other pairs are added up per document and joined with the counts by shuffle.
    """
    spark = docs.sparkSession
    aligned = stage(_align(docs, a_path, b_path, _packed, "binary").withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stage(count_pairs(aligned, a_path, b_path), "pairs")
    n_b_ids = len(piece_bpe(b_path).lengths)
    # One row per id of B: the vocabulary bounds it.
    best = counts.groupBy(F.pmod("pair", F.lit(n_b_ids)).alias("b")).agg(F.max("n").alias("n")).toPandas()
    highest = np.zeros(n_b_ids, np.int64)
    highest[best["b"].to_numpy(np.int64)] = best["n"].to_numpy(np.int64)
    head = _head(counts, head_pairs)
    shared = spark.sparkContext.broadcast((head["pair"].to_numpy(np.int64), head["n"].to_numpy(np.int64), highest))

    def run(batches):
        a, b = byte_bpe(a_path), piece_bpe(b_path)
        pairs, n, most = shared.value
        for batch in batches:
            for part in _slices(batch):
                codes, at, (a_ids, a_at), (b_ids, b_at) = _codes(part, a, b)
                (a_in, g_at), (b_in, _) = _unpacked(part, "a_in_group", COUNT), _unpacked(part, "b_in_group", COUNT)
                place = np.searchsorted(pairs, codes)
                known = place < len(pairs)
                known[known] = pairs[place[known]] == codes[known]
                count = np.zeros(len(codes), np.int64)
                count[known] = n[place[known]]
                top = known & (count == most[codes % len(b.lengths)])
                rest, r_at = codes[~known], np.concatenate([[0], np.cumsum(~known)])[at]
                rows = [np.unique(rest[s:e], return_counts=True) for s, e in zip(r_at[:-1], r_at[1:])]
                sizes = np.concatenate([[0], np.cumsum([len(p) for p, _ in rows], dtype=np.int64)])
                left = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate([x[k] for x in rows]).astype(np.int64)) for k in (0, 1)], ["pair", "n"])
                said = [hashlib.sha256(t).hexdigest() if t else "" for t in group_texts(a_ids, a_in, b_ids, b_in, g_at)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id")] + [pa.array(np.asarray(x, np.int64)) for x in (
                        np.diff(a_at), np.diff(b_at), np.diff(g_at), np.diff(at), _sums(top, at), _sums(count, at))]
                    + [pa.array(said, pa.string()), pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), left)],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rest"])

    scored = stage(aligned.mapInArrow(run, SCORED), "scored")
    rare = scored.select("row", F.explode("rest").alias("x")).select("row", "x.pair", F.col("x.n").alias("times"))
    most = counts.groupBy(F.pmod("pair", F.lit(n_b_ids)).alias("b")).agg(F.max("n").alias("most"))
    met = rare.join(counts, "pair").withColumn("b", F.pmod("pair", F.lit(n_b_ids))).join(most, "b")
    added = met.groupBy("row").agg(
        F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    out = scored.drop("rest").join(added, "row", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256")


def _head(counts: DataFrame, most: int):
    """The pairs of highest count, sorted by pair: all with a count of at least 2**k, for the least k that gives ``most``
    or fewer."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r.k: r["count"] for r in counts.groupBy(level.alias("k")).count().collect()}
    least, total = 64, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        least = k
    return counts.where(level >= least).orderBy("pair").toPandas()
