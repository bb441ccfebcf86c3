"""Substring dedup by collinear chaining.

Texts are winnowed into k-mer seeds. Every occurrence of a seed meets the seed's first occurrence in the corpus and the one
just before it, so a passage that a thousand documents share gives two thousand matches, not a million. Where matches
with whatever documents lie close together in a text, those with one document are chained in order, with costs for gaps,
through Fenwick trees over the ends that lie near; chains are aligned word by word on the two texts, and what is long and alike enough is a
repeated passage.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.llm.words import chunks, hash_words, mix, runs, signed
from wattledger.staging import settle, stage

KMER = 5
#: Of any so many neighbouring k-mers one is a seed: equal runs of KMER + WINNOW - 1 words share a seed, and one seed at
#: least lies across any two words.
WINNOW = 4
#: Words of a gap that a chain may bridge, and what a word of gap costs, in either text, against a matched word.
MOST_GAP, GAP_COST = 40, 0.2
LEAST_WORDS, LEAST_IDENTITY = 50, 0.8
#: Words at either end of a passage that may be without seeds.
EDGE = 24
#: Words around a chain that the alignment may claim: a single seed is enough to find a whole passage.
MARGIN = LEAST_WORDS
#: Stretches that a text lends at once.
REQUESTS = 500
#: Seeds that a task matches at once, and bytes a lent word travels as.
MATCH_ROWS, WORD_BYTES = 1 << 16, 3
#: Chains, and words of them, that share one lent stretch of their document. A longer chain has one of its own.
LOT_CHAINS, LOT_WORDS = 16, 2000


def winnow(kmers: np.ndarray, sizes: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Positions, in the concatenated k-mers of several texts, of the least k-mer of every window of a text (all of them
    where several are equal). A text of fewer k-mers than a window is one window."""
    n = len(kmers)
    if not n:
        return np.zeros(0, np.int64)
    order = mix(kmers ^ np.uint64(0x5DEECE66D))
    ends = np.cumsum(sizes)
    some = sizes > 0
    room = np.repeat(ends, sizes) - np.arange(n)  # k-mers from here to the end of the text
    picked = np.zeros(n, bool)
    whole = np.repeat(np.minimum.reduceat(order, (ends - sizes)[some]), sizes[some])
    picked |= (order == whole) & (np.repeat(sizes, sizes) < window)
    m = n - window + 1
    if m > 0:
        least = order[:m].copy()
        for j in range(1, window):
            np.minimum(least, order[j:j + m], out=least)
        inside = room[:m] >= window
        for j in range(window):
            picked[j:j + m] |= inside & (order[j:j + m] == least)
    return np.flatnonzero(picked)


def _seeds(batches):
    for batch in batches:
        ids = batch["doc_id"].to_numpy()
        for first, texts in chunks(batch["text"]):
            words = hash_words(texts)
            sizes = np.maximum(np.diff(words.offsets) - KMER + 1, 0)
            local = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kmers = runs(words.hashes, KMER)[np.repeat(words.offsets[:-1], sizes) + local] if len(local) else np.zeros(0, np.uint64)
            at = winnow(kmers, sizes)
            yield pd.DataFrame({"doc_id": np.repeat(ids[first:first + len(texts)], sizes)[at], "at": local[at].astype(np.int32), "seed": signed(kmers[at])})


def segments(group: np.ndarray, at: np.ndarray, other: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """For each group, by number, its maximal equal runs (start, start in the other, words) in order: seeds on one diagonal
    that overlap or touch."""
    order = np.lexsort((at, other - at, group))
    g, a, d = group[order], at[order], (other - at)[order]
    new = np.ones(len(a), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (a[1:] - a[:-1] > KMER)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    parts = list(zip(a[first].tolist(), (a[first] + d[first]).tolist(), (a[last] - a[first] + KMER).tolist()))
    begin = np.flatnonzero(np.diff(g[first], prepend=-1)).tolist()
    for lo, hi in zip(begin, [*begin[1:], len(parts)]):
        yield sorted(parts[lo:hi])


class Ends:
    """Fenwick trees over where parts end in the other text, each node with the maxima of a sliding window over where they
    end in the text itself.

    Ends are put in by rising end in the text, and asked for by rising start. A node keeps those whose value no later one
    exceeds, so its best is its first that has not fallen out of the window. The other text is cut into blocks of a
    window's width, each with a tree over prefixes and one over suffixes: a window is a suffix of one block and a prefix
    of the next. Putting in and asking both visit as many nodes as a width has bits.
    """

    WIDTH = MOST_GAP + KMER // 2 + 1

    def __init__(self) -> None:
        self.nodes: dict[tuple[int, int, int], deque[tuple[float, int, int]]] = {}

    def put(self, end: int, other_end: int, value: float, part: int) -> None:
        block, slot = divmod(other_end, self.WIDTH)
        entry = (value, end, part)
        for side, i in ((0, slot + 1), (1, self.WIDTH - slot)):
            while i <= self.WIDTH:
                node = self.nodes.get((block, side, i))
                if node is None:
                    node = self.nodes[block, side, i] = deque()
                while node and node[-1][0] < value:
                    node.pop()
                node.append(entry)
                i += i & -i

    def best(self, least_end: int, least_other: int) -> tuple[float, int]:
        """(value, part) of the best end that is not before ``least_end``, with the other end in the ``WIDTH`` words from
        ``least_other``; part -1 if there is none."""
        block, slot = divmod(least_other, self.WIDTH)
        asked = [(block, 1, self.WIDTH - slot)] + ([(block + 1, 0, slot)] if slot else [])
        found = (float("-inf"), -1)
        for block, side, i in asked:
            while i > 0:
                node = self.nodes.get((block, side, i))
                while node and node[0][1] < least_end:
                    node.popleft()
                if node and node[0][0] > found[0]:
                    found = (node[0][0], node[0][2])
                i -= i & -i
        return found


def best_before(parts: list[tuple[int, int, int]]) -> tuple[list[float], list[int]]:
    """For each part, in order, the score of the best chain that ends with it and the part before it in that chain (-1: none).

    A chain's score is its words minus the costs of its gaps, by their length in both texts. A part may follow one that ends
    at most ``MOST_GAP`` words before it, and at most half a seed behind its start, in either text.
    """
    score: list[float] = []
    before: list[int] = []
    stop = [x + n for x, _, n in parts]
    waiting = sorted(range(len(parts)), key=stop.__getitem__)
    ends = Ends()
    done = 0
    for x, y, n in parts:
        while done < len(waiting) and stop[j := waiting[done]] <= x + KMER // 2:
            ex, ey = stop[j], parts[j][1] + parts[j][2]
            ends.put(ex, ey, score[j] + GAP_COST * (ex + ey), j)
            done += 1
        value, j = ends.best(x - MOST_GAP, y - MOST_GAP)
        linked = value - GAP_COST * (x + y) > 0
        score.append(n + (value - GAP_COST * (x + y) if linked else 0.0))
        before.append(j if linked else -1)
    return score, before


def chain(parts: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of parts in order of their start, the best first. Each part is in one chain."""
    if len(parts) == 1:
        return [parts]
    score, before = best_before(parts)
    used = [False] * len(parts)
    out = []
    for k in sorted(range(len(parts)), key=lambda k: (-score[k], k)):
        path = []
        while k >= 0 and not used[k]:
            used[k] = True
            path.append(parts[k])
            k = before[k]
        if path:
            out.append(path[::-1])
    return out


def blocks(batches, rows: int = MATCH_ROWS):
    """Arrow batches joined to blocks of at least ``rows`` rows (the last may be smaller)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _earlier(batches):
    """Matches of seeds, sorted by (seed, doc_id, at), with the first and the previous occurrence.

    ``kind`` 0: a match within the partition. 1: an occurrence of the partition's first seed, whose first occurrence may
    lie in an earlier partition. 2: the partition's first row. 3: its last row, with the first occurrence of its seed here.
    """
    part = TaskContext.get().partitionId()
    names = ["doc_id", "at", "other_id", "there", "seed"]

    def rows(kind, *columns):
        n = len(columns[0])
        ends = [np.full(n, kind, np.int32), np.full(n, part, np.int32)]
        types = [np.int64, np.int32, np.int64, np.int32, np.int64]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in ends + [np.asarray(c).astype(t) for c, t in zip(columns, types)]], ["kind", "part", *names])

    last = None  # seed, doc_id, at of the row before; doc_id, at of its seed's first row here
    seen = 0
    for block in blocks(batches):
        seed, doc, at = (block[c].to_numpy().astype(np.int64) for c in ("seed", "doc_id", "at"))
        if not len(seed):
            continue
        if last is None:
            yield rows(2, doc[:1], at[:1], doc[:1], at[:1], seed[:1])
        was = last or (seed[0] ^ 1, 0, 0, 0, 0)
        new = np.diff(seed, prepend=was[0]) != 0
        begun = np.maximum.accumulate(np.where(new, np.arange(len(seed)), -1))
        first_doc, first_at = np.where(begun >= 0, doc[begun], was[3]), np.where(begun >= 0, at[begun], was[4])
        back_doc, back_at = np.append(was[1], doc[:-1]), np.append(was[2], at[:-1])
        head = seen + np.cumsum(new) == 1
        seen += int(new.sum())
        back = ~new & ((back_doc != doc) | (back_at != at))
        first = ~new & ~head & ((first_doc != doc) | (first_at != at)) & ((first_doc != back_doc) | (first_at != back_at))
        yield rows(0, *(np.concatenate(v) for v in (
            (doc[back], doc[first]), (at[back], at[first]), (back_doc[back], first_doc[first]), (back_at[back], first_at[first]), (seed[back], seed[first]))))
        if head.any():
            yield rows(1, doc[head], at[head], doc[head], at[head], seed[head])
        last = (seed[-1], doc[-1], at[-1], first_doc[-1], first_at[-1])
    if last:
        yield rows(3, *([v] for v in last[1:]), [last[0]])


def _meet(seeds: DataFrame) -> DataFrame:
    """``doc_id, at, other_id, there``: every occurrence of a seed with the seed's first and with the previous one.

    Occurrences are sorted over all partitions, so one seed may fill many. What is carried from one partition to the next
    is worked out on the driver, from two rows a partition.
    """
    ranged = seeds.repartitionByRange("seed", "doc_id", "at").sortWithinPartitions("seed", "doc_id", "at")
    rows = stage(ranged.mapInArrow(_earlier, "kind int, part int, doc_id long, at int, other_id long, there int, seed long"), "met")
    edges = sorted(rows.where("kind > 1").collect(), key=lambda r: (r.part, r.kind))  # two rows a partition
    carried, fixed = None, []
    for head, tail in zip(edges[::2], edges[1::2]):
        on = carried is not None and carried[0] == head.seed
        first = carried[1] if on else (head.doc_id, head.at)
        fixed.append((head.part, *first, *(carried[2] if on else (None, None)), head.doc_id, head.at))
        carried = (tail.seed, first if tail.seed == head.seed else (tail.other_id, tail.there), (tail.doc_id, tail.at))
    fixes = F.broadcast(seeds.sparkSession.createDataFrame(
        fixed, "part int, first_doc long, first_at int, back_doc long, back_at int, head_doc long, head_at int"))
    heads = rows.where("kind = 1").join(fixes, "part")
    columns = ["doc_id", "at", "other_id", "there"]
    return rows.where("kind = 0").select(*columns).unionAll(
        heads.where("first_doc <> doc_id or first_at <> at").select("doc_id", "at", "first_doc", "first_at").toDF(*columns)).unionAll(
        heads.where("doc_id = head_doc and at = head_at and (back_doc <> doc_id or back_at <> at)").select("doc_id", "at", "back_doc", "back_at").toDF(*columns))


def link(doc: int, other: np.ndarray, at: np.ndarray, there: np.ndarray) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(other document, chain) to be aligned, from all matches of a document.

    A stretch of the document that is too short for a passage, whatever its matches are with, has no chains. All other
    chains are kept, also those within a longer passage: they may be another document's, and may reach beyond it.
    """
    if not len(at):
        return []
    order = np.lexsort((other, at))
    other, at, there = other[order], at[order], there[order]
    stretch = np.cumsum(np.diff(at, prepend=at[:1]) > KMER + MOST_GAP)
    begin = np.flatnonzero(np.diff(stretch, prepend=-1))
    reach = at[np.append(begin[1:], len(at)) - 1] + KMER - at[begin] + 2 * EDGE
    long = (reach >= LEAST_WORDS)[stretch]
    other, at, there, stretch = other[long], at[long], there[long], stretch[long]
    # A group: the matches of a stretch with one document.
    order = np.lexsort((other, stretch))
    o, t = other[order], stretch[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1])
    group = np.empty(len(o), np.int64)
    group[order] = np.cumsum(new) - 1
    return [(own, path) for own, parts in zip(o[new].tolist(), segments(group, at, there)) for path in chain(parts)]


def lots(found: list[tuple[int, list[tuple[int, int, int]]]]) -> list[list[tuple[int, list[tuple[int, int, int]]]]]:
    """Chains of a document by their start, in lots that share one lent stretch of the document."""
    out: list[list[tuple[int, list[tuple[int, int, int]]]]] = []
    words = 0
    for other, path in sorted(found, key=lambda c: (c[1][0][0], c[0], c[1])):
        size = path[-1][0] + path[-1][2] - path[0][0]
        if not out or len(out[-1]) == LOT_CHAINS or words + size > LOT_WORDS or path[0][0] > out[-1][0][1][0][0] + LOT_WORDS:
            out.append([])
            words = 0
        out[-1].append((other, path))
        words += size
    return out


CHAINS = pa.schema([("doc_id", pa.int64()), ("lot", pa.int32()), ("from", pa.int32()), ("to", pa.int32()), ("other_id", pa.list_(pa.int64())),
                    ("other_from", pa.list_(pa.int32())), ("other_to", pa.list_(pa.int32())), ("parts", pa.list_(pa.list_(pa.int32())))])


def _chainer(batches):
    for batch in batches:
        m = batch.column("m")
        rows = []
        for doc, matches in zip(batch.column("doc_id").to_pylist(), m):
            other, at, there = (matches.values.field(c).to_numpy().astype(np.int64) for c in ("other_id", "at", "there"))
            for k, lot in enumerate(lots(link(doc, other, at, there))):
                rows.append((
                    doc, k, lot[0][1][0][0], max(p[-1][0] + p[-1][2] for _, p in lot), [o for o, _ in lot],
                    [p[0][1] for _, p in lot], [p[-1][1] + p[-1][2] for _, p in lot], [[v for part in p for v in part] for _, p in lot]))
        yield pa.RecordBatch.from_pylist([dict(zip(CHAINS.names, row)) for row in rows], CHAINS)


def align_gap(a: np.ndarray, b: np.ndarray) -> int:
    """Words of ``a`` and ``b`` that an optimal alignment of the two stretches matches (longest common subsequence)."""
    n = min(len(a), len(b))
    if not n:
        return 0
    # Equal words at either end are matched by an optimal alignment; mostly a changed word or two are left.
    apart = np.flatnonzero(a[:n] != b[:n])
    head = int(apart[0]) if len(apart) else n
    a, b, n = a[head:], b[head:], n - head
    if not n:
        return head
    apart = np.flatnonzero(a[len(a) - n:] != b[len(b) - n:])
    tail = n - 1 - int(apart[-1]) if len(apart) else n
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 0 or len(b) == 1:
        return head + tail
    row = np.zeros(len(b) + 1, np.int32)
    for w in a:
        row[1:] = np.maximum(np.maximum.accumulate(np.maximum(row[1:], np.where(b == w, row[:-1] + 1, 0))), row[1:])
    return head + tail + int(row[-1])


def extend(a: np.ndarray, b: np.ndarray, at: np.ndarray, there: np.ndarray, room: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, matched words) of the stretches that stay alike from ``at`` in ``a`` and ``there`` in ``b``, each of at most
    ``room`` words in direction ``step``: they may cross single differing words, and end on an equal one."""
    most = int(room.max(initial=0))
    if not most:
        return np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    away = np.arange(most)
    inside = away < room[:, None]
    places = [np.where(inside, start[:, None] + step * away, 0) for start in (at, there)]
    same = (a[places[0]] == b[places[1]]) & inside
    run = np.cumsum(np.where(same, 1, -2), axis=1)
    run[~inside] = -3 * most
    best = run.argmax(axis=1)
    words = np.where(run[np.arange(len(at)), best] > 0, best + 1, 0)
    return words, (same & (away < words[:, None])).sum(axis=1)


def equal_words(a: np.ndarray, b: np.ndarray, runs_: np.ndarray, n: int, words: int = 1 << 20) -> np.ndarray:
    """Words that the runs (chain, start in ``a``, start in ``b``, length) have in common, by chain; some ``words`` at a time."""
    out = np.zeros(n, np.int64)
    lot = np.cumsum(runs_[:, 3]) // words
    for some in np.split(runs_, np.flatnonzero(np.diff(lot)) + 1):
        if len(some):
            chain_, at, there, size = some.T
            first = np.cumsum(size) - size
            inside = np.arange(int(size.sum()))
            same = a[inside + np.repeat(at - first, size)] == b[inside + np.repeat(there - first, size)]
            np.add.at(out, chain_, np.add.reduceat(same, first, dtype=np.int64))
    return out


def align(a: np.ndarray, b: np.ndarray, chains: list[tuple[int, int, int, int, list[tuple[int, int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """(begin, end, other begin, other end, matched words) of chains, aligned on stretches of two arrays of words.

    A chain is (begin and end of its stretch of ``a``, begin and end of that of ``b``, its parts in places of the arrays).
    """
    spans, whole = [], []
    for k, (_, _, _, _, parts) in enumerate(chains):
        (px, py, _), matched = parts[0], 0
        for x, y, n in parts:
            if px > x or py > y:
                d = max(px - x, py - y)
                x, y, n = x + d, y + d, n - d
            if n > 0:
                if px < x and py < y:
                    matched += align_gap(a[px:x], b[py:y])
                whole.append((k, x, y, n))
                px, py = x + n, y + n
        spans.append((*parts[0][:2], px, py, matched))
    x, y, ex, ey, matched = np.array(spans, np.int64).reshape(-1, 5).T
    matched = matched + equal_words(a, b, np.array(whole, np.int64).reshape(-1, 4), len(spans))
    lo, hi, other_lo, other_hi = np.array([c[:4] for c in chains], np.int64).reshape(-1, 4).T
    back, some = extend(a, b, x - 1, y - 1, np.minimum(x - lo, y - other_lo), -1)
    more, others = extend(a, b, ex, ey, np.minimum(hi - ex, other_hi - ey), 1)
    return list(zip((x - back).tolist(), (ex + more).tolist(), (y - back).tolist(), (ey + more).tolist(), (matched + some + others).tolist()))


def _slices(batches):
    """Words [from, to) of each requested stretch, ``WORD_BYTES`` of hash a word."""
    for batch in batches:
        for first, texts in chunks(batch["text"]):
            words = hash_words(texts)
            short = (words.hashes >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :WORD_BYTES]
            out = []
            asked = zip(*(batch[c].iloc[first:first + len(texts)] for c in ("asker", "lot", "place", "from", "to")))
            for k, lists in enumerate(asked):
                own = short[words.offsets[k]:words.offsets[k + 1]]
                for asker, lot, at, begin, end in zip(*(v.tolist() for v in lists)):
                    lo = max(0, begin - MARGIN)
                    out.append((asker, lot, at, lo, own[lo:end + MARGIN].tobytes()))
            yield pd.DataFrame(out, columns=["asker", "lot", "place", "lo", "words"])


def unpack(slices: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of lent stretches (binary) in one array, and the offsets of the stretches."""
    wide = slices.cast(pa.large_binary())
    at = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset:wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    raw = np.frombuffer(wide.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(-1, WORD_BYTES) if at[-1] > at[0] else np.zeros((0, WORD_BYTES), np.uint8)
    words = np.zeros((len(raw), 4), np.uint8)
    words[:, :WORD_BYTES] = raw
    return words.reshape(-1).view("<u4"), (at - at[0]) // WORD_BYTES


def _aligner(batches):
    for batch in batches:
        r = {c: batch.column(c).to_pylist() for c in batch.schema.names if c not in ("words", "parts")}
        words, at = unpack(batch.column("words").flatten())
        at = at.tolist()
        lists = batch.column("parts").flatten()  # one list of numbers a chain
        numbers, cuts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).tolist()
        first = np.concatenate([[0], np.cumsum(batch.column("parts").value_lengths().to_numpy())]).tolist()
        chains, whose = [], []
        i = 0
        for k, places in enumerate(r["place"]):
            lent = [(place, at[i + j], at[i + j + 1], lo) for j, (place, lo) in enumerate(zip(places, r["lo"][k]))]
            i += len(places)
            owns = [own[1:] for own in lent if own[0] < 0]
            for place, other_begin, other_end, other_lo in lent:
                if place < 0:
                    continue
                flat = numbers[cuts[first[k] + place]:cuts[first[k] + place + 1]].tolist()
                for begin, end, lo in owns:
                    dx, dy = begin - lo, other_begin - other_lo
                    parts = [(x + dx, y + dy, n) for x, y, n in zip(flat[::3], flat[1::3], flat[2::3])]
                    if parts[-1][0] + parts[-1][2] <= end and parts[-1][1] + parts[-1][2] <= other_end:  # else a variant of the document that ends before
                        chains.append((begin, end, other_begin, other_end, parts))
                        whose.append((k, place, dx, dy))
        best: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
        for (k, place, dx, dy), (x, ex, y, ey, matched) in zip(whose, align(words, words, chains) if chains else []):
            x, ex, y, ey = x - dx, ex - dx, y - dy, ey - dy
            if r["doc_id"][k] != r["other_id"][k][place] or max(x, y) >= min(ex, ey):  # else a text that repeats itself within the stretch
                best[k, place] = max(best.get((k, place), (-1, 0, 0, 0, 0)), (matched, x, ex, y, ey))
        rows = [(r["doc_id"][k], r["other_id"][k][place], x, ex, y, ey, matched, matched / max(ex - x, ey - y)) for (k, place), (matched, x, ex, y, ey) in best.items()
                if matched >= LEAST_IDENTITY * max(ex - x, ey - y) and ex - x >= LEAST_WORDS]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(FOUND), FOUND)], schema=FOUND)


FOUND = pa.schema([("doc_id", pa.int64()), ("other_id", pa.int64()), *((c, pa.int32()) for c in ("from_word", "to_word", "other_from", "other_to", "matched")), ("identity", pa.float64())])


def find_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, other_id, from_word, to_word, other_from, other_to, matched, identity``: stretches of at least
    ``LEAST_WORDS`` words (runs without white space) of a document that an earlier one (by id; or the same one, earlier
    in it) holds at ``LEAST_IDENTITY`` or more. The document that has a passage first has no row for it as ``doc_id``.

    Only ``doc_id`` and ``text`` are read. Rows without an id cannot be named and take no part. Null, empty and short
    texts hold no passage. Rows that share an id are variants of one document and are not compared with each other;
    whole repeated rows count once. Ties go to the first position. An empty table gives no rows. Very long texts are
    worked on whole; what they repeat becomes as many chains.

    A seed with a third of all occurrences is sorted into many partitions. The two texts of a chain only lend the words
    around it; chains that begin close together share what their document lends.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    seeds = base.mapInPandas(_seeds, "doc_id long, at int, seed long")
    chains = settle(base.sparkSession, lambda: _meet(seeds).groupBy("doc_id").agg(F.collect_set(F.struct("other_id", "at", "there")).alias("m")).mapInArrow(
        _chainer, "doc_id long, lot int, `from` int, `to` int, other_id array<long>, other_from array<int>, other_to array<int>, parts array<array<int>>"), "chains")

    sides = chains.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("asker"), "lot", F.lit(-1).alias("place"), "from", "to").unionAll(
        chains.select("doc_id", "lot", F.posexplode(F.arrays_zip("other_id", "other_from", "other_to"))).select(
            F.col("col.other_id"), "doc_id", "lot", "pos", F.col("col.other_from"), F.col("col.other_to")))
    # A document that very many others repeat lends from several rows of its own.
    shares = sides.groupBy(F.col("id").alias("_id")).agg(F.ceil(F.count("*") / REQUESTS).alias("shares"))
    wanted = sides.join(shares, F.col("id") == F.col("_id")).groupBy("id", F.pmod(F.xxhash64("asker", "lot", "place"), "shares").alias("share")).agg(
        F.collect_list(F.struct("asker", "lot", "place", "from", "to")).alias("wanted"))
    lent = base.join(wanted, F.col("doc_id") == F.col("id")).select("text", *[F.col(f"wanted.{c}").alias(c) for c in ("asker", "lot", "place", "from", "to")]).mapInPandas(
        _slices, "asker long, lot int, place int, lo int, words binary")
    both = lent.groupBy("asker", "lot").agg(F.collect_list(F.struct("place", "lo", "words")).alias("lent")).withColumnRenamed("lot", "_lot")
    return chains.join(both, (F.col("doc_id") == F.col("asker")) & (F.col("lot") == F.col("_lot"))).select(
        "doc_id", "other_id", "parts", *[F.col(f"lent.{c}").alias(c) for c in ("place", "lo", "words")]).mapInArrow(
        _aligner, "doc_id long, other_id long, from_word int, to_word int, other_from int, other_to int, matched int, identity double")
