"""Token alignment, spelling variants and one-bit codes against brute force, and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wattledger.llm import bit_codes, spelling, token_alignment

FOLDER = "/opt/tokenizers"
CLASHES = ["1 AS size", "2 AS `row`", "3 AS pair", "4 AS n", "5 AS word", "6 AS cell", "7 AS _k", "8 AS dim", "9 AS asker"]


# --- token alignment

TEXTS = [
    "Plain words, and some more of them; don't split 1234 things.", "", None, " ", "  two  spaces\n\n\tand tabs ", "日本語 ñandú 🎉 x", "a▁b",
    "<|endoftext|> </s> <s> [INST]", "\x00 nul and \x7f", "é" * 40, " " * 3000 + "x", "word " * 2000 + "end", "aaaa" * 3000, "same text", "same text",
]


def _token_bytes():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")
    symbols = token_alignment._byte_symbols()

    def first(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids]

    def second(text):
        ids = b.encode(text)
        return ids, [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids)]

    return first, second


def _spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def _brute_alignment(texts):
    first, second = _token_bytes()
    docs, counts = [], Counter()
    for text in texts:
        if not text:
            docs.append(None)
            continue
        (a, ab), (b, bb) = first(text), second(text)
        whole = (" " + text).encode()
        if b"".join(ab) != whole or b"".join(bb) != whole:
            docs.append(None)
            continue
        sa, sb = _spans(ab), _spans(bb)
        links, j0 = [], 0
        for i, (s, e) in enumerate(sa):
            while sb[j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(sb) and sb[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        counts.update(links)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(x) for x, (s, e) in zip(a, sa) if low <= s and e <= cut) + "|" + ",".join(str(x) for x, (s, e) in zip(b, sb) if low <= s and e <= cut))
            low = cut
        docs.append((len(a), len(b), len(cuts), links, ";".join(groups)))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, g, links, text = d
            out.append((a, b, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("head", [0, 40, 1 << 20])
def test_alignment_equals_brute_force(spark, head):
    texts = [t if t is None or len(t) < 1000 else t[:700] + t[-30:] for t in TEXTS]
    docs = spark.createDataFrame([(i if i != 13 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", *CLASHES)
    got = [(-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in token_alignment.alignment_report(docs, head_pairs=head).collect()]
    assert sorted(got) == sorted((i if i != 13 else -1, *row) for i, row in enumerate(_brute_alignment(texts)))


def test_both_encoders_agree_on_long_and_odd_texts(spark):
    first, second = _token_bytes()
    rng = random.Random(3)
    odd = ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(300)) for _ in range(20)]
    texts = [*TEXTS, *odd, "\n" * 5000 + "a" * 5000]
    rows = token_alignment.align_tokens(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    for r in rows:
        text = texts[r.doc_id]
        if not text or "▁" in text:
            assert r.a_ids == r.b_ids == r.a_in_group == []
            continue
        (a, ab), (b, bb) = first(text), second(text)
        if b"".join(bb) != (" " + text).encode():
            assert r.b_ids == []
        else:
            assert (r.a_ids, r.b_ids) == (a, b) and sum(r.a_in_group) == len(a) and sum(r.b_in_group) == len(b)
            ends = {e for _, e in _spans(ab)} & {e for _, e in _spans(bb)}
            assert len(r.a_in_group) == len(r.b_in_group) == len(ends)


def test_cuts_by_halving_are_all_common_ends():
    rng = np.random.default_rng(5)
    for _ in range(60):
        sizes, a, b, a_at, b_at, low = rng.integers(0, 60, 6), [], [], [0], [0], 0
        for n in sizes:
            if n:
                for ends, share in ((a, rng.random()), (b, rng.random())):
                    inner = low + 1 + np.flatnonzero(rng.random(n - 1) < share)
                    ends.extend([*inner, low + n])
                low += n
            a_at.append(len(a))
            b_at.append(len(b))
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        i, j = token_alignment.common_cuts(a, b, np.array(a_at), np.array(b_at)) if len(a) else (a, b)
        assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()


def test_alignment_of_an_empty_table(spark):
    assert token_alignment.alignment_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- spelling

def _near(s, t):
    if s == t or abs(len(s) - len(t)) > 1:
        return False
    if len(s) == len(t):
        return sum(a != b for a, b in zip(s, t)) == 1
    s, t = sorted((s, t), key=len)
    return any(t[:k] + t[k + 1:] == s for k in range(len(t)))


def _brute_forms(rows, every):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= 6
    words = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}
    out = {}
    for w, n in words.items():
        near = [v for v in words if _near(w, v)]
        form = min(near, key=lambda v: (-words[v], v), default=None)
        form = form if form and words[form] >= 5 * n else None
        out[w] = [form, n, len(near), words.get(form)]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return sorted((w, *v) for w, v in out.items())


def test_spelling_equals_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("abé", k=n)) for n in (6, 6, 7, 8, 9, 12) for _ in range(6)] + ["aaaaaa", "aaaaaaa", "ÀÉÎõü÷×", "zebraé"]
    words = []
    for w in base:
        words += [w] * rng.choice([5, 30, 160, 900])
        for _ in range(4):
            k = rng.randrange(len(w) + 1)
            v = rng.choice([w[:k] + rng.choice("abé") + w[k:], w[:k] + w[k + 1:], w[:k] + "b" + w[k + 1:]])
            words += [v.upper() if rng.random() < .2 and v.isascii() else v] * rng.choice([4, 5, 8, 40])
    rng.shuffle(words)
    rows = [(i, " ".join(words[k:k + 97])) for i, k in enumerate(range(0, len(words), 97))]
    rows += [(None, "aaaaaa aaaaab"), (7, None), (8, ""), (8, ""), (900, "1 2,3-4 _"), (901, "x" * 200_000 + " " + "zebraé " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *CLASHES)
    for every in (199, 3):
        got = spelling.spelling_forms(docs, delete_every=every)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(tuple(r) for r in got.collect()) == _brute_forms(rows, every)
    assert sum(w[1] is not None for w in _brute_forms(rows, 199)) > 10
    assert spelling.spelling_forms(docs.limit(0)).count() == 0


def test_chain_of_forms_ends_at_its_root(spark):
    chain = ["aaaaaaaaaa"[:10 - k] + "bbbbbbbbbb"[:k] for k in range(6)]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(5 ** (k + 1)))
    got = {r.word: (r.form, r.root) for r in spelling.spelling_forms(spark.createDataFrame([(1, text)], "doc_id long, text string"), delete_every=1 << 33).collect()}
    assert got == {w: (chain[k + 1] if k < 5 else None, chain[5]) for k, w in enumerate(chain)}


# --- one-bit codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def _brute_neighbours(rows, every, keep):
    usable = [(i, tuple(np.float32(v))) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)]
    usable = {i: min(v for k, v in usable if k == i) for i, _ in usable}
    out = []
    for q in sorted(i for i in usable if i % every == 0):
        best = {i: float(bit_codes.distances(np.array([v], float), np.array([usable[q]], float))[0]) for i, v in usable.items() if i != q and len(v) == len(usable[q])}
        ranked = sorted(best.items(), key=lambda x: (x[1], x[0]))[:keep]
        out += [(q, k + 1, i, float(d)) for k, (i, d) in enumerate(ranked)]
    return out


def test_neighbours_equal_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(150)]
    rows += [(i, [1.0] * 8) for i in range(200, 260)] + [(300, [1.0] * 8), (300, [1.0] * 8), (20, rng.standard_normal(8).tolist())]
    rows += [(400, None), (410, []), (420, [0.0] * 8), (430, [None] * 8), (440, [float("nan")] * 8), (450, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(500, [1.0, 2.0]), (501, [2.0, 2.0]), (600, [3.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).selectExpr("*", *CLASHES)
    got = sorted(tuple(r) for r in bit_codes.nearest_neighbours(df, 10).collect())
    want = _brute_neighbours(rows, 10, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == [w[3] for w in want]
    assert bit_codes.nearest_neighbours(df.limit(0)).count() == 0


def test_recall_over_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(bit_codes, "CELL", 64)
    monkeypatch.setattr(bit_codes, "BLOCK", 48)
    rng = np.random.default_rng(6)
    hot = rng.standard_normal(24)
    x = np.concatenate([rng.standard_normal((1500, 24)), hot + 1e-3 * rng.standard_normal((800, 24))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA)
    got = bit_codes.nearest_neighbours(df, 20).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hits = 0
    for q in range(0, len(x), 20):
        gap = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        gap[q] = np.inf
        hits += len({i for _, i in found[q]} & set(np.argsort(gap, kind="stable")[:10].tolist()))
        assert all(abs(gap[i] - d) < 1e-12 for d, i in found[q]) and len(found[q]) == 10
    assert hits >= 0.95 * 10 * len(found)


def test_lower_bounds_hold():
    rng = np.random.default_rng(8)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((50, 64))
    codes, length, own = bit_codes.encode(x)
    assert codes.shape == (2000, 8)
    true = ((q[:, None] - x[None]) ** 2).sum(2)
    low = bit_codes.lower_bounds(q, codes, length, own)
    assert (low > true).mean() < 2e-4
    assert np.corrcoef(low.ravel(), true.ravel())[0, 1] > 0.8 and (low > np.quantile(true, 0.005)).mean() > 0.3
