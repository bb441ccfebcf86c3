"""The operators of ``llm`` on small tables: brute force, round trips, held-out accuracy, and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wattledger.llm import chat_format, decontamination, embeddings_dedup, html_extract, jaccard_join, licences, mixing, sharding, substring_dedup, toxicity
from wattledger.llm.components import components
from wattledger.llm.queries import QUERIES, SQL
from wattledger.llm.words import hash_words

SF = "/root/testdata/sf0.001"
SYLLABLES = "ba ce di fo gu ka le mi no pu ra se ti vo zu".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(SYLLABLES, k=3)) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, a shared passage, nulls, blanks, a long text, and columns that clash with internal ones."""
    a, b, passage = prose(1, 200), prose(2, 120), prose(3, 70)
    near = a.copy()
    near[60] = "changed"
    far = a[:100] + prose(4, 100)
    rows = [
        (1, " ".join(a), "s"), (2, " ".join(a), "s"), (3, " ".join(near), "t"), (4, " ".join(far), None), (5, " ".join(b), "t"),
        (6, None, "s"), (7, "", None), (8, " \n\t ", "s"), (9, "one two", "s"), (10, "one two", "t"), (None, " ".join(a), "s"), (None, None, None),
        (11, " ".join(prose(5, 60) + passage + prose(6, 40)), "u"), (12, " ".join(prose(7, 10) + passage + prose(8, 90)), "u"),
        (13, " ".join(prose(9, 30_000)), "s"), (14, " ".join(b), "t"), (14, " ".join(b), "t"),
    ]
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).selectExpr("*", "1 AS size", "2 AS row", "3 AS _row", "4 AS shard", "5 AS component")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_are_maximal_runs():
    texts = ["a  bb\tccc", "", "é\u00a0x", "a"]
    w = hash_words(texts)
    assert np.diff(w.offsets).tolist() == [len(WORD.findall(t)) for t in texts]
    assert w.hashes[0] == w.hashes[-1] and len(set(w.hashes.tolist())) == 4


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and all(got[i] == 100 for i in range(100, 140)) and got[201] == 200 and len(got) == 72
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_jaccard_join_equals_brute_force(spark, docs, empty):
    rows = [(r.doc_id, tuple(WORD.findall(r.text or ""))) for r in docs.collect()]
    sets = [{w[k:k + 5] for k in range(max(len(w) - 4, 1))} if w else set() for _, w in rows]
    links = [sum(i != j and bool(s | t) and len(s & t) >= 0.8 * len(s | t) for j, t in enumerate(sets)) for i, s in enumerate(sets)]
    got = jaccard_join.jaccard_join(docs).collect()
    assert sorted((r.doc_id or -1, r.n_links) for r in got) == sorted((i or -1, n) for (i, _), n in zip(rows, links))
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[3].component_id == by_id[2].component_id == 1 and by_id[4].kept and not by_id[10].kept and by_id[7].kept and by_id[7].n_links == 0
    left = jaccard_join.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in left.collect()) == [-1, 1, 4, 5, 6, 7, 8, 9, 11, 12, 13]
    assert jaccard_join.jaccard_join(empty).count() == 0 and jaccard_join.drop_near_duplicates(empty).count() == 0


def test_bayesian_bound_keeps_pairs_at_the_threshold():
    least = jaccard_join.least_matches(0.8, 200)
    rng = np.random.default_rng(1)
    draws = rng.random((2000, 200)) < 0.8
    assert all((draws[:, :n].sum(axis=1) >= m).all() for n, m in zip(range(40, 201, 40), least)) and least[0] > 15


def test_decontamination_finds_planted_items_only(spark, docs, empty, monkeypatch):
    items = {1: prose(21, 40), 2: prose(22, 16), 3: prose(23, 150), 4: ["one", "two"]}
    bench = spark.createDataFrame([(k, " ".join(v) + ".") for k, v in items.items()] + [(5, None), (6, ""), (1, " ".join(items[1]) + ".")], "item_id long, text string")
    planted = [(100 + k, "„" + " ".join(prose(30 + k, 77) + [w.upper() for w in items[k]] + prose(40 + k, 50)), "en", "s", 0) for k in (1, 2, 3)]
    half = [(104, " ".join(prose(50, 40) + items[1][:12] + prose(51, 40)), "en", "s", 0)]
    every = docs.select(*empty.columns).union(spark.createDataFrame(planted + half, SCHEMA))
    got = {(r.doc_id, r.item_id) for r in decontamination.find_contamination(every, bench).where("contaminated").collect()}
    assert got == {(101, 1), (102, 2), (103, 3)}
    left = decontamination.decontaminate(every, bench)
    assert left.count() == every.count() - 3 and left.columns == every.columns
    with monkeypatch.context() as m:  # a benchmark of several passes
        m.setattr(decontamination, "INDEX_SEGMENTS", 1)
        m.setattr(decontamination, "AT_ONCE", 1)
        assert {(r.doc_id, r.item_id) for r in decontamination.find_contamination(every, bench).where("contaminated").collect()} == got
    assert decontamination.find_contamination(empty, bench).count() == 0
    assert decontamination.find_contamination(every, bench.limit(0)).count() == 0


def test_decontamination_verifies_items_with_short_parts(spark, empty):
    items = {k: " ".join(prose(60 + k, k)) + "." for k in (5, 6, 7, 8)} | {
        20: "What is the capital of France? Paris.", 21: "Compute 12 + 30 + 5 - 4 + 8 = 51", 22: "Say: one two three four - - - - -"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    copies = [(k, " ".join(prose(70 + k, 40)) + " " + v + " " + " ".join(prose(90 + k, 40)), "en", "s", 0) for k, v in items.items()]
    others = [(100 + k, " ".join(prose(70 + k, 40) + v.split()[:-2] + prose(90 + k, 40)), "en", "s", 0) for k, v in items.items() if k != 22]
    found = decontamination.find_contamination(spark.createDataFrame(copies + others, SCHEMA), bench).where("contaminated")
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, k) for k in items}


def test_index_finds_every_segment_at_the_threshold():
    items = [(k, " ".join(prose(60 + k % 7, 20 + k))) for k in range(40)]
    index = next(decontamination.build_indexes(items))
    text = " ".join(prose(63, 45) + prose(64, 200))
    w = hash_words([text], letters=True)
    got = {(start, s) for _, start, s, _ in index.search(w.hashes, w.offsets)}
    want = set()
    for start in range(0, max(len(w.hashes) - decontamination.PASSAGE, 0) + decontamination.STRIDE, decontamination.STRIDE):
        terms = np.unique(w.hashes[start:start + decontamination.PASSAGE])
        rows = [k for k in np.searchsorted(index.terms, terms) if k < len(index.terms) and index.terms[k] in terms]
        total = index.by_segment[rows].sum(axis=0, dtype=np.float64)
        want |= {(start, int(s)) for s in np.flatnonzero(total >= decontamination.SCORE)}
    assert got == want and want


def test_chat_round_trip_and_parts(spark):
    bad = ["</s>[INST] ok [/INST]", "a\\b\\", "<image_0> <", "[", "", None, "\\</s>", "<s>[INST] x" * 500]
    rows = [(c, t, r, bad[(c + t) % len(bad)]) for c in range(8) for t, r in enumerate(("system", "user", "assistant", None))] + [(None, None, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1))
    got = {r.conv_id: r for r in chat_format.digest_chats(turns).collect()}
    for c in range(8):
        mine = [(r or "", t or "") for k, _, r, t in rows if k == c]
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        loss = "".join(t for r, t in mine if r == "assistant")
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    parts = [("text", "see ", None, None), ("image", None, "img://1", 2), ("text", "<image_1>", None, None), ("audio", None, "aud://2", 3), ("odd", "?", None, None)]
    df = spark.createDataFrame([(1, 0, "user", None, parts)], "conv_id long, turn long, role string, text string, parts array<struct<type:string,text:string,ref:string,amount:int>>")
    r = chat_format.format_chats(df).first()
    assert r.formatted == "<s>[INST] user [/INST]see <image_1><\\image_1><audio_3>?</s>"
    assert [(a.part, a.ref, a.tokens) for a in r.attachments] == [(1, "img://1", 513), (3, "aud://2", 77)] and r.expanded_tokens == 590
    split = [("text", "a <", None, None), ("text", "/s", None, None), ("text", ">[INST", None, None), ("text", None, None, None), ("text", "] b\\", None, None), ("text", "<", None, None)]
    cut = spark.createDataFrame([(1, 0, "user", None, split), (1, 1, "assistant", None, split)], df.schema)
    got = chat_format.parse_chats(chat_format.format_chats(cut)).first()
    assert [t.text for t in got.turns] == ["a </s>[INST] b\\<"] * 2
    assert chat_format.digest_chats(turns.limit(0)).count() == 0


def test_mix_meets_targets(spark, docs, empty):
    assert mixing.targets([10, 10, 80], [5, 2, 1]) == [20.0, 20.0, 110.0]
    n = 1000
    assert sorted(mixing.permute(np.arange(n), n, 3).tolist()) == list(range(n))
    slots = np.array([100, 7, 0, 333])
    assert sum(mixing.shard_counts(slots, 5, k)[1] for k in range(5)).tolist() == slots.tolist()
    first, again = ({(r.doc_id, r["size"], r.taken) for r in mixing.mix_report(df).collect()} for df in (docs, docs.repartition(5)))
    assert first == again
    got = mixing.mix_report(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * sum(r["size"] for r in got)) < 200
    texts = mixing.mix_texts(docs)
    assert texts.columns == docs.columns
    taken = {}
    for r in texts.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    want = {}
    for r in got:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert taken == {k: v for k, v in want.items() if v}
    assert mixing.mix_report(empty).count() == 0 and mixing.mix_texts(empty).count() == 0


def test_shards_are_even_and_match_the_mixture(spark, docs, empty):
    many = spark.range(803).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"), F.lit(0).alias("slot"))
    for df in (many, docs.union(docs)):
        got = sharding.shard_report(df).collect()
        slots = {k: sorted(r.slot for r in got if r.shard == k) for k in range(8)}
        assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_report(many.repartition(7)).collect()}
    rows = sharding.shard_report(many).collect()
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}
    for s in ("a", "b", None):
        counts = [sum(r.source == s and r.shard == k for r in rows) for k in range(8)]
        assert max(counts) - min(counts) <= 2
    r = sharding.shard_report(docs).where("doc_id = 6").first()
    assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (1, 0, "rows", None)
    assert sharding.shard_report(empty).count() == 0


def test_toxicity_gradients_and_held_out(spark, docs, empty):
    rng = np.random.default_rng(3)
    net = toxicity.Network(1)
    net.p["word"] += rng.normal(0, 0.3, net.p["word"].shape).astype(np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    w = toxicity.Windows(hash_words([" ".join(prose(1, 5)), " ".join(prose(2, 3))], letters=True))
    label, weight = np.array([1.0, 0.0]), np.ones(2)
    grad = net.gradients(w, label, weight)

    def loss():
        z = net.forward(net.inputs(w)[1], w.ids)[0]
        return float((np.log1p(np.exp(z)) - label * z).mean())

    for name in ("x", "f", "b", "a", "v", "o", "ob"):
        spot = tuple(rng.integers(0, n) for n in net.p[name].shape)
        net.p[name][spot] += 1e-3
        up = loss()
        net.p[name][spot] -= 2e-3
        assert abs((up - loss()) / 2e-3 - grad[name][spot]) < 2e-4 + 0.02 * abs(grad[name][spot]), name
        net.p[name][spot] += 1e-3
    rows = []
    for i in range(300):
        words = prose(1000 + i, 60 + i % 150)
        if i % 3 == 0:
            words[i % 50] = random.Random(i).choice(("vilest", "vilely", "viler"))
        rows.append((i, " ".join(words), "en", "s", 0))
    corpus = spark.createDataFrame(rows, SCHEMA).union(docs.select(*empty.columns).where("doc_id is null or doc_id in (6, 7, 8)"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(corpus, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id > 10]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in held]) > 0.9
    assert len(got) == corpus.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.drop_toxic(corpus, labels).columns == corpus.columns
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.score_toxicity(corpus, labels.limit(0)).collect()} == {0}


def test_embeddings_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3000, 24))
    base[:200] = base[0] + 0.12 * rng.normal(size=(200, 24)) * np.linalg.norm(base[0]) / 24 ** 0.5
    base[200:400] = base[400:600] + 0.05 * rng.normal(size=(200, 24))
    base[600:700] = base[600]
    odd = [(9001, None, 1), (9002, [0.0] * 24, 1), (9003, [None] + [1.0] * 23, 1), (9004, [float("nan")] + [1.0] * 23, 1), (9005, base[0].tolist(), None),
           (None, base[0].tolist(), 1), (9006, [float("inf")] * 24, 1), (9007, [1.0], 1), (9008, [], 1)]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(base)] + odd, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit(0))
    got = {r.vec_id: r for r in embeddings_dedup.link_embeddings(df).collect()}
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    truth = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(base))])
    assert (found <= truth).all() and found.sum() >= 0.95 * truth.sum() and (found[600:700] == truth[600:700]).all()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(9001, 9009)) and got[None].component_id is None
    assert got[650].component_id == 600 and not got[650].kept and 0.9 <= got[0].audit_recall <= 1
    assert embeddings_dedup.link_embeddings(df.limit(0)).count() == 0


def test_repeats_cover_shared_passages(spark, docs, empty):
    got = substring_dedup.find_repeats(docs).collect()
    pair = next(r for r in got if (r.doc_id, r.other_id) == (12, 11))
    assert (pair.from_word, pair.to_word, pair.other_from, pair.other_to, pair.identity) == (10, 80, 60, 130, 1.0)
    assert any((r.doc_id, r.other_id, r.from_word, r.to_word) == (2, 1, 0, 200) for r in got)
    assert any((r.doc_id, r.other_id) == (3, 1) and r.to_word - r.from_word == 200 and r.matched == 199 for r in got)
    assert not any(r.doc_id in (1, 5, 13) for r in got)
    assert substring_dedup.find_repeats(empty).count() == 0


def test_chain_takes_collinear_parts():
    parts = [(0, 0, 20), (5, 300, 10), (25, 27, 20), (200, 60, 30)]
    assert [(0, 0, 20), (25, 27, 20)] in substring_dedup.chain(sorted(parts))


def test_chain_passes_over_a_long_part_that_is_too_far():
    near = [(260 + 21 * i, 260 + 20 * i, 20) for i in range(7)]  # a word put in after every 20
    assert near in substring_dedup.chain(sorted([(0, 0, 200)] + near))


def test_chains_are_the_best_by_brute_force():
    rng = np.random.default_rng(4)
    for span in (60, 200, 900):
        parts = sorted({(int(x), int(y), int(n)) for x, y, n in zip(rng.integers(0, span, 150), rng.integers(0, span, 150), rng.integers(5, 30, 150))})
        score, before = substring_dedup.best_before(parts)
        want: list[float] = []
        for x, y, n in parts:
            gaps = [(x - a - m, y - b - m, want[j]) for j, (a, b, m) in enumerate(parts[:len(want)])]
            want.append(n + max([0.0] + [w - substring_dedup.GAP_COST * (gx + gy) for gx, gy, w in gaps
                                         if -(substring_dedup.KMER // 2) <= min(gx, gy) and max(gx, gy) <= substring_dedup.MOST_GAP]))
        assert np.allclose(score, want)
        assert any(j >= 0 for j in before) and all(j < k for k, j in enumerate(before))


def test_repeats_whose_parts_came_earlier_apart(spark):
    """Passages of two lines; documents before had the lines one by one, and others had one line in between."""
    texts = []
    for k in range(25):
        one, two = prose(1000 + k, 30), prose(1100 + k, 30)
        for i, body in enumerate((one, two, one + two, one, one + two)):
            texts.append((100 * k + i, prose(2000 + 10 * k + i, 40) + body + prose(3000 + 10 * k + i, 40)))
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in texts]
    got = substring_dedup.find_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    found = {r.doc_id for r in got if r.other_id == r.doc_id - 2 and (r.from_word, r.to_word) == (40, 100)}
    assert found == {100 * k + 4 for k in range(25)}


def test_seeds_meet_first_and_previous_in_any_partitioning(spark):
    rows = [(i % 7, i, i % 3) for i in range(200)] + [(50, 1, 9), (50, 1, 9)]
    seeds = spark.createDataFrame(rows, "doc_id long, at int, seed long")
    want = set()
    for seed in {r[2] for r in rows}:
        spots = sorted({r[:2] for r in rows if r[2] == seed})
        want |= {(*b, *a) for a, b in zip(spots, spots[1:])} | {(*b, *spots[0]) for b in spots[1:]}
    for n in ("1", "40"):
        was = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {tuple(r) for r in substring_dedup._meet(seeds).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == want
    assert substring_dedup._meet(seeds.limit(0)).count() == 0


def test_a_passage_within_a_longer_one_keeps_its_partner(spark):
    """Document 3 repeats the beginning of 1 and, inside that, a passage of 2."""
    at = np.arange(0, 116, 3)
    inner = at[(at >= 30) & (at < 96)]
    found = substring_dedup.link(3, np.repeat([1, 2], [len(at), len(inner)]), np.concatenate([at, inner]), np.concatenate([at, inner + 500]))
    assert sorted({o for o, _ in found}) == [1, 2]
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words[:120])), (2, " ".join(words[200:260] + words[30:100] + words[300:340])), (3, " ".join(words[:120] + words[360:400]))]
    got = {(r.doc_id, r.other_id) for r in substring_dedup.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(3, 1), (3, 2)} <= got


@pytest.mark.parametrize("every, words, most", [(10, 50, 0), (10, 120, 0), (9, 50, 0), (8, 50, 0), (7, 50, 0.03), (7, 80, 0)])
def test_seeds_find_changed_passages(every, words, most):
    """Share of passages, one word changed of ``every``, whose seeds lead to no chain."""
    missed = 0
    for k in range(100):
        a = prose(5000 + k, words)
        b = [w if i % every != every // 2 else w + "x" for i, w in enumerate(a)]
        h = [substring_dedup.runs(hash_words([" ".join(t)]).hashes, substring_dedup.KMER) for t in (a, b)]
        at = [substring_dedup.winnow(v, np.array([len(v)])) for v in h]
        first = {h[0][i]: i for i in at[0]}
        hits = np.array([(1, i, first[h[1][i]]) for i in at[1] if h[1][i] in first], np.int64).reshape(-1, 3)
        missed += not substring_dedup.link(2, *hits.T)
    assert missed <= most * 100, missed


def test_pages(spark):
    page = "<body><nav><a href=x>menu</a></nav><div class='cookie-notice'>cookies</div><article><h1>T &amp; t</h1><p>Hello <b>wor</b>ld<p>x &lt;y&gt;<div class=comments>c</div></article><footer>f</footer>"
    rows = [(1, "http://www.h.com/1", page), (2, "https://h.com/2", page), (3, None, None), (4, "", ""), (5, "http://h.com/5", "<p>only"), (None, "x", "<div>a<br>b"), (1, "http://h.com/1", page)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()
    assert len(got) == 7 and sorted(r.text for r in got) == sorted(["T & t\nHello world\nx <y>"] * 3 + ["", "", "only", "a b"])
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_keep_titles_and_leads_beside_comments(spark):
    title, lead, body, comments = (" ".join(prose(110 + k, n))[:n] for k, n in enumerate((30, 200, 2000, 700)))
    titled = f"<body><article><h1>{title}</h1><div class=body>{body}</div><div class=comments>{comments[:100]}</div></article></body>"
    led = f"<body><article><div class=lead>{lead}</div><div class=body>{body[:800]}</div><div class=comments>{comments}</div></article></body>"
    bare = f"<body><article><div class=body>{body}</div></article></body>"
    linked = f"<body><div class=list><a href=x>{comments}</a></div><article><div class=lead>{lead}</div><div class=body>{body}</div></article></body>"
    pages = [("a", titled)] * 3 + [("b", led)] * 3 + [("c", bare)] * 5 + [("c", titled), ("c", led), ("c", linked)]
    rows = [(k, f"http://{host}.com/{k}", html) for k, (host, html) in enumerate(pages)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {titled: f"{title}\n{body}", led: f"{lead}\n{body[:800]}", bare: body, linked: f"{lead}\n{body}"}
    assert got == {k: "\n".join(line.strip() for line in want[html].split("\n")) for k, (_, html) in enumerate(pages)}


def test_licences(spark, empty):
    mit = next(t for a, t in licences.KNOWN if t.startswith("MIT License"))
    changed = mit.replace("<year> <copyright holders>", "2024 Someone").replace("sublicense", "sub-license").upper()
    rows = [(1, changed, "", "", 0), (2, "x\nReleased under the MIT Licence!\ny", "", "", 0), (3, None, "", "", 0), (4, " . ", "", "", 0), (5, "nothing here", "", "", 0), (None, "Licensed under CC BY-NC 4.0", "", "", 0)]
    got = {(r.doc_id, r.line, r.licence) for r in licences.scan_licences(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, -1, "MIT"), (2, -1, None), (2, 1, "MIT"), (3, -1, None), (4, -1, None), (5, -1, None), (None, -1, "CC-BY-NC-4.0"), (None, 0, "CC-BY-NC-4.0")}
    assert licences.scan_licences(empty).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, duck, name):
    from oracle_check import compare

    assert compare(QUERIES[name](spark, SF), duck, SQL[name]) is None


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, before, SF)
        assert after.columns == docs.columns, name
        before = spark.createDataFrame(after.toPandas(), docs.schema)
    assert before.count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert last.count() == before.count() == last.select("shard", "slot").distinct().count()


def test_runs_of_chains_are_compared_at_once():
    """Equal words of all runs by chain, over lots smaller than the runs; lent stretches are read from Arrow without copies a stretch."""
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 3, 500, dtype=np.uint32), rng.integers(0, 3, 400, dtype=np.uint32)
    some = np.array([(k // 3, rng.integers(0, 400), rng.integers(0, 300), rng.integers(1, 100)) for k in range(60)], np.int64)
    want = np.zeros(21, np.int64)
    for k, x, y, n in some:
        want[k] += (a[x:x + n] == b[y:y + n]).sum()
    for words in (1, 70, 1 << 20):
        assert substring_dedup.equal_words(a, b, some, 21, words).tolist() == want.tolist()
    assert substring_dedup.equal_words(a, b, some[:0], 2).tolist() == [0, 0]
    lent = pa.array([b"abcdef", b"", b"xyz"], pa.binary())
    words, at = substring_dedup.unpack(lent.slice(1))
    assert at.tolist() == [0, 0, 1] and words.tolist() == [int.from_bytes(b"xyz", "little")]
    assert substring_dedup.unpack(lent.slice(3))[1].tolist() == [0]
