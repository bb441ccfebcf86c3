"""Orientation and sums in tour order against brute force, in one task and by rounds of joins."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from wattledger.operators import network, powerflow, tours
from wattledger.staging import stage

EDGES = "feeder string, segment_id string, from_node string, to_node string, length_km double"


def _brute(edges, sources):
    """Breadth-first tree: parent is the smallest neighbour one level up, segment its smallest."""
    out = {}
    for feeder, source in sources.items():
        lines = [e for e in edges if e[0] == feeder and e[2] is not None and e[3] is not None]
        near = {}
        for _, s, a, b, km in lines:
            near.setdefault(a, []).append((b, s, km))
            near.setdefault(b, []).append((a, s, km))
        if source not in near:
            continue
        depth, queue = {source: 0}, deque([source])
        while queue:
            at = queue.popleft()
            for to, _, _ in near[at]:
                if to not in depth:
                    depth[to] = depth[at] + 1
                    queue.append(to)
        for node, level in depth.items():
            up = min(((p, s, km) for p, s, km in near[node] if depth.get(p) == level - 1), default=(None, None, 0.0))
            out[feeder, node] = (*up, level)
    return out


def _check(spark, edges, sources):
    e = spark.createDataFrame(edges, EDGES)
    tree = network.orient(e, spark.createDataFrame(list(sources.items()), "feeder string, source string")).collect()
    got = {(r.feeder, r.node): (r.parent, r.segment_id, r.length_km, r.depth) for r in tree}
    assert len(got) == len(tree) and got == _brute(edges, sources)
    # Tour order: a subtree is a range of places, right behind its node.
    by = {(r.feeder, r.node): r for r in tree}
    for r in tree:
        below = sorted(x.place for x in tree if x.feeder == r.feeder and r.place <= x.place < r.place + r.size)
        assert below == list(range(r.place, r.place + r.size))
        if r.parent is not None:
            up = by[r.feeder, r.parent]
            assert up.place < r.place and r.place + r.size <= up.place + up.size
    for f in sources:
        roots = [r for r in tree if r.feeder == f and r.parent is None]
        assert all(r.size == sum(x.feeder == f for x in tree) for r in roots)


def _graph(rng, feeder, n, extra, loose):
    """A tree with edges either way, ``extra`` chords or parallel lines, and a loop apart from it."""
    lines = []
    for k in range(1, n):
        a, b = f"n{rng.randrange(max(0, k - 4), k):03d}", f"n{k:03d}"
        lines.append((a, b) if rng.random() < 0.5 else (b, a))
    for _ in range(extra):
        lines.append(tuple(rng.sample([f"n{k:03d}" for k in range(n)], 2)))
    if loose:
        lines += [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x1", "x1"), ("y", None)]
    rng.shuffle(lines)
    return [(feeder, f"s{k:03d}" if rng.random() > 0.1 else f"s{k % 3:03d}", a, b, round(rng.random(), 3)) for k, (a, b) in enumerate(lines)]


@pytest.mark.parametrize("piece", [tours.PIECE, 20, 0])
def test_orientation_equals_breadth_first_search(spark, monkeypatch, piece):
    monkeypatch.setattr(tours, "PIECE", piece)
    rng = random.Random(piece)
    edges = _graph(rng, "A", 30, 0, True) + _graph(rng, "B", 40, 6, True) + _graph(rng, "C", 12, 0, False) + _graph(rng, "D", 25, 25, False)
    edges += [("E", "e1", "p", "q", 1.0), ("F", "f1", "r", "s", 1.0), ("F", "f0", "s", "r", 2.0)]
    _check(spark, edges, {"A": "n000", "B": "n007", "C": "n011", "D": "n000", "E": "absent", "F": "s", "G": "no edges"})


@pytest.mark.parametrize("piece", [tours.PIECE, 0])
def test_reversed_chain_takes_rounds_by_the_logarithm_of_its_length(spark, monkeypatch, piece):
    monkeypatch.setattr(tours, "PIECE", piece)
    n, written = 1000, []
    monkeypatch.setattr(tours, "stage", lambda df, label="stage", keep=tours.stage: written.append(label) or keep(df, label))
    e = spark.createDataFrame([("L", f"s{k:04d}", f"n{k + 1:04d}", f"n{k:04d}", 1.0) for k in range(n)], EDGES)
    tree = network.orient(e, spark.createDataFrame([("L", "n0000")], "feeder string, source string"))
    got = tree.agg(F.count("*"), F.max("depth"), F.sum("place"), F.sum("size"), F.sum(F.expr("depth - place"))).first()
    assert tuple(got) == (n + 1, n, n * (n + 1) // 2, (n + 1) * (n + 2) // 2, 0)
    assert len(written) <= (3 if piece else 8 * 10)


def test_no_edges_no_tree(spark):
    empty = spark.createDataFrame([], EDGES)
    assert network.orient(empty, spark.createDataFrame([("L", "r")], "feeder string, source string")).count() == 0


@pytest.mark.parametrize("block", [tours.BLOCK, 7])
def test_sums_over_subtrees_and_paths(spark, monkeypatch, block):
    monkeypatch.setattr(tours, "BLOCK", block)
    rng = random.Random(3)
    edges = _graph(rng, "A", 60, 0, False) + _graph(rng, "B", 9, 0, False)
    tree = network.orient(spark.createDataFrame(edges, EDGES), spark.createDataFrame([("A", "n000"), ("B", "n004")], "feeder string, source string"))
    rows = tours.in_blocks(tree).withColumns({"one": F.lit(1.0), "km": F.col("length_km")})
    parent = {(r.feeder, r.node): r.parent for r in tree.collect()}
    km = {(r.feeder, r.node): r.length_km for r in tree.collect()}

    def path(key):
        while key[1] is not None:
            yield key
            key = (key[0], parent[key])

    below = {k: [0.0, 0.0] for k in parent}
    for k in parent:
        for a in path(k):
            below[a][0] += 1
            below[a][1] += km[k]
    for r in tours.subtree_totals(rows, ["one", "km"]).collect():
        assert [r.one, r.km] == pytest.approx(below[r.feeder, r.node])
    for r in tours.path_totals(rows, ["one", "km"]).collect():
        assert r.one == r.depth + 1 and r.km == pytest.approx(sum(km[a] for a in path((r.feeder, r.node))))
    up = network.trace_upstream(tree, tree.where("size = 1").select("feeder", "node")).collect()
    leaves = [k for k in parent if below[k][0] == 1]
    assert {(r.feeder, r.start, r.node, r.steps) for r in up} == {(f, n, a[1], k) for f, n in leaves for k, a in enumerate(path((f, n)))}


@pytest.mark.parametrize("block", [tours.BLOCK, 5])
def test_flow_satisfies_its_equations(spark, monkeypatch, block):
    monkeypatch.setattr(tours, "BLOCK", block)
    rng = random.Random(5)
    # A segment named twice gives its node one impedance, not two rows.
    edges = [(f, f"s{k:03d}" if k > 1 else "twice", a, b, km, "C0", 3, 13800.0) for k, (f, _, a, b, km) in enumerate(e for e in _graph(rng, "A", 40, 2, False) + _graph(rng, "B", 12, 0, True))]
    e = spark.createDataFrame(edges, EDGES + ", conductor string, n_phases int, voltage_v double")
    sources = spark.createDataFrame([("A", "n000"), ("B", "n003")], "feeder string, source string")
    tree = network.orient(e, sources)
    z = powerflow.impedances(tree, e, spark.createDataFrame([("C0", 0.5, 0.4)], "code string, r_ohm_km double, x_ohm_km double"))
    loads = tree.select("feeder", "node", (F.col("place") % 5 * 20.0).alias("kw"), F.lit(0.9).alias("pf"))
    flow = powerflow.balanced_flow(z, loads, powerflow.base_voltages(z, e, sources), max_sweeps=12)
    for r in powerflow.flow_residuals(flow).collect():
        assert r.drop_pu < 1e-9 and r.current_pu < 1e-5 and r.power_pu < 1e-5
    assert flow.where("converged").count() == tree.count()


@pytest.mark.parametrize("block", [5])
def test_sweeps_move_ranges_and_no_nodes(spark, monkeypatch, block):
    """Whatever the sweeps, rows of single nodes are written on the way in and on the way out; ranges do not change the result."""
    rng = random.Random(11)
    # A: some 40 nodes (a multiple of 5); C: one line, whose subtrees all stop at its end; D: a node alone with its source.
    graph = _graph(rng, "A", 39, 0, False) + [("C", f"c{k}", f"n{k:03d}", f"n{k + 1:03d}", 0.1) for k in range(23)] + [("D", "d", "n000", "n001", 0.2)]
    edges = [(f, s, a, b, km, "C0", 3, 13800.0) for f, s, a, b, km in graph]
    e = spark.createDataFrame(edges, EDGES + ", conductor string, n_phases int, voltage_v double")
    sources = spark.createDataFrame([(f, "n000") for f in "ACD"], "feeder string, source string")
    tree = network.orient(e, sources)
    z = powerflow.impedances(tree, e, spark.createDataFrame([("C0", 0.5, 0.4)], "code string, r_ohm_km double, x_ohm_km double"))
    loads = tree.select("feeder", "node", *[(F.col("place") % (k + 3) * 20.0).alias(f"kw_{c}") for k, c in enumerate("abc")])
    base = powerflow.base_voltages(z, e, sources)
    columns = ["feeder", "node", *[f"{x}_{c}" for c in "abc" for x in ("vr", "vi", "ir", "ii")], "converged", "iterations"]
    want = {r[:2]: r[2:] for r in powerflow.unbalanced_flow(z, loads, base, tolerance=1e-9).select(*columns).collect()}
    monkeypatch.setattr(tours, "BLOCK", block)
    written = []
    monkeypatch.setattr(powerflow, "stage", lambda df, label="stage": written.append(label) or stage(df, label))
    got = {r[:2]: r[2:] for r in powerflow.unbalanced_flow(z, loads, base, tolerance=1e-9).select(*columns).collect()}
    assert len(got) == tree.count() and got.keys() == want.keys()
    for k, r in got.items():
        assert r[:-2] == pytest.approx(want[k][:-2], rel=1e-9, abs=1e-9) and r[-2:] == want[k][-2:] and r[-2]
    assert written.count("flow3") == 2
