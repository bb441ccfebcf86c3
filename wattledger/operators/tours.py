"""Rooted trees in tour order, and sums over them as prefix sums.

A depth-first tour gives every node its ``place`` and the ``size`` of its subtree, so a subtree is a range of places of
its feeder. Sums over subtrees and over paths to the source then are differences of prefix sums: ranges of places
(``BLOCK`` of them) are added up by themselves, and one row a range carries the offsets. Depth does not matter, and a
feeder with a third of all nodes is many ranges.

Feeders of up to ``PIECE`` edges are oriented in one task each, breadth first. Larger ones are oriented by rounds of
joins whose number grows with the logarithm of their size: a spanning forest by hooking each component to its least
edge (hashes decide, so that chains of hooks stay short) and pointer jumping, then an Euler tour of the forest ranked by
list doubling. Where a large feeder has meshes, depths are shortened over the edges outside the forest until they are
those of a breadth-first search.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattledger.operators.ranking import global_rank
from wattledger.staging import stage

#: Edges of a feeder that one task orients.
PIECE = 1 << 16
#: Places of a range whose values one task adds up.
BLOCK = 1 << 15
TREE = ["feeder", "node", "parent", "segment_id", "length_km", "depth", "place", "size"]


# --- one feeder in one task ------------------------------------------------------

def _breadth_first(tail: np.ndarray, head: np.ndarray, n: int, root: int) -> np.ndarray:
    """Depth of each of ``n`` nodes over the arcs, -1 where no path leads."""
    order = np.argsort(tail, kind="stable")
    at = np.searchsorted(tail[order], np.arange(n + 1))
    heads = head[order]
    depth = np.full(n, -1, np.int64)
    depth[root] = 0
    front, level = np.array([root]), 0
    while len(front):
        level += 1
        count = at[front + 1] - at[front]
        arcs = np.repeat(at[front] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        front = np.unique(heads[arcs])
        front = front[depth[front] < 0]
        depth[front] = level
    return depth


def _tour_places(parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in the depth-first order and subtree size; children in the order of their numbers. -1 is no parent."""
    order = np.lexsort((np.arange(len(parent)), parent, depth))
    cut = np.flatnonzero(np.diff(depth[order])) + 1
    levels = np.split(order, cut)
    size = np.ones(len(parent), np.int64)
    for nodes in reversed(levels[1:]):
        np.add.at(size, parent[nodes], size[nodes])
    place = np.zeros(len(parent), np.int64)
    for nodes in levels[1:]:
        above, total = parent[nodes], np.cumsum(size[nodes]) - size[nodes]
        first = np.flatnonzero(np.diff(above, prepend=-1))
        place[nodes] = place[above] + 1 + total - np.repeat(total[first], np.diff(np.append(first, len(nodes))))
    return place, size


def _orient_feeder(edges: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    edges = edges.dropna(subset=["from_node", "to_node"])
    names, ends = np.unique(np.concatenate([edges["from_node"], edges["to_node"]]), return_inverse=True)
    root = np.searchsorted(names, sources["source"].iloc[0]) if len(sources) and len(names) else len(names)
    if root >= len(names) or names[root] != sources["source"].iloc[0]:
        return pd.DataFrame(columns=TREE, dtype=object)
    a, b = np.split(ends, 2)
    tail, head = np.concatenate([a, b]), np.concatenate([b, a])
    depth = _breadth_first(tail, head, len(names), root)
    # Of the neighbours one level up the smallest; of its segments the smallest.
    line = np.tile(np.arange(len(edges)), 2)
    up = np.flatnonzero((depth[tail] >= 0) & (depth[head] == depth[tail] + 1))
    kinds = pd.factorize(edges["segment_id"], sort=True)[0]
    length = edges["length_km"].fillna(0.0).to_numpy()
    up = up[np.lexsort((length[line[up]], kinds[line[up]], tail[up], head[up]))]
    node, first = np.unique(head[up], return_index=True)
    up = up[first]
    parent, segment, km = np.full(len(names), -1), np.full(len(names), None, object), np.zeros(len(names))
    parent[node], segment[node], km[node] = tail[up], edges["segment_id"].to_numpy(object)[line[up]], length[line[up]]
    reached = np.flatnonzero(depth >= 0)
    number = np.full(len(names), -1)
    number[reached] = np.arange(len(reached))
    above = np.where(parent[reached] >= 0, number[parent[reached]], -1)
    place, size = _tour_places(above, depth[reached])
    return pd.DataFrame({
        "feeder": edges["feeder"].iloc[0], "node": names[reached], "parent": np.where(above >= 0, names[parent[reached]], None),
        "segment_id": segment[reached], "length_km": km[reached], "depth": depth[reached], "place": place, "size": size})


# --- large feeders by rounds of joins --------------------------------------------

def _ends_of(edges: DataFrame) -> DataFrame:
    """``feeder, a, b`` with a < b: which nodes an edge joins."""
    return edges.where("from_node <> to_node").select(
        "feeder", F.least("from_node", "to_node").alias("a"), F.greatest("from_node", "to_node").alias("b")).distinct()


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs(feeder, a, b)`` that form a spanning tree of every component.

    Every component takes the least edge that leaves it (by a hash, so least edges are unique and scattered), hooks onto
    the component beyond, and is contracted by pointer jumping. Each round at least halves the components.
    """
    live = stage(pairs.withColumn("key", F.xxhash64("feeder", "a", "b")).withColumns({"ca": F.col("a"), "cb": F.col("b")}), "live")
    chosen = None
    while True:
        ends = live.select("feeder", F.inline(F.array(
            F.struct(F.col("ca").alias("comp"), F.struct("key", "a", "b", F.col("cb").alias("beyond")).alias("edge")),
            F.struct(F.col("cb").alias("comp"), F.struct("key", "a", "b", F.col("ca").alias("beyond")).alias("edge")))))
        pick = stage(ends.groupBy("feeder", "comp").agg(F.min("edge").alias("edge")), "pick")
        if pick.isEmpty():
            return stage(chosen.distinct(), "forest") if chosen is not None else pairs
        taken = pick.select("feeder", "edge.a", "edge.b")
        chosen = taken if chosen is None else chosen.union(taken)
        # Two components that took the same edge: the smaller one is the root.
        other = pick.select("feeder", F.col("comp").alias("up"), F.col("edge.beyond").alias("__back"))
        hooked = pick.select("feeder", "comp", F.col("edge.beyond").alias("up")).join(other, ["feeder", "up"])
        hooks = stage(hooked.where(~((F.col("__back") == F.col("comp")) & (F.col("comp") < F.col("up")))).select("feeder", "comp", "up"), "hooks")
        while True:
            onward = hooks.select("feeder", F.col("comp").alias("up"), F.col("up").alias("__next"))
            longer = stage(hooks.join(onward, ["feeder", "up"], "left").select(
                "feeder", "comp", F.coalesce("__next", "up").alias("up"), F.col("__next").isNotNull().alias("__moved")), "hooks")
            hooks = longer.drop("__moved")
            if longer.where("__moved").isEmpty():
                break
        for c in ("ca", "cb"):
            live = live.join(hooks.select("feeder", F.col("comp").alias(c), "up"), ["feeder", c], "left").withColumn(c, F.coalesce("up", c)).drop("up")
        live = stage(live.where("ca <> cb"), "live")


def euler_tour(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """``feeder, node, parent, depth, place, size`` of the trees ``pairs(feeder, a, b)`` that hold a source.

    The arc u -> v is followed by the arc from v to the neighbour after u. Doubling ranks the arcs of the tour that starts
    at the source; a node is entered by the earlier of the two arcs that join it to its parent.
    """
    slots = pairs.select("feeder", F.inline(F.array(
        F.struct(F.col("a").alias("at"), F.col("b").alias("to")), F.struct(F.col("b").alias("at"), F.col("a").alias("to")))))
    slots = stage(global_rank(slots, [F.col("feeder"), F.col("at"), F.col("to")], out="slot"), "slots")
    around = slots.groupBy("feeder", "at").agg(F.min("slot").alias("first"), F.max("slot").alias("last"))
    after = stage(slots.join(around, ["feeder", "at"]).select(
        "feeder", "at", "to", "slot", F.when(F.col("slot") < F.col("last"), F.col("slot") + 1).otherwise(F.col("first")).alias("after")), "after")
    start = around.join(sources.select("feeder", F.col("source").alias("at")), ["feeder", "at"]).select("feeder", F.col("first").alias("start"))
    back = after.select("feeder", F.col("to").alias("at"), F.col("at").alias("to"), F.col("slot").alias("back"), F.col("after").alias("next"))
    arcs = stage(after.drop("after").join(back, ["feeder", "at", "to"]).join(start, "feeder").withColumn(
        "next", F.when(F.col("next") != F.col("start"), F.col("next"))).drop("start"), "arcs")
    longest = arcs.groupBy("feeder").count().agg(F.max("count")).first()[0] or 0
    run = stage(arcs.select("slot", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("dist")), "run")
    for _ in range(int(longest).bit_length()):
        ahead = run.select(F.col("slot").alias("next"), F.col("next").alias("__next"), F.col("dist").alias("__dist"))
        run = stage(run.join(ahead, "next", "left").select(
            "slot", F.col("__next").alias("next"), (F.col("dist") + F.coalesce("__dist", F.lit(0))).alias("dist")), "run")
    ended = run.where("next is null").select("slot", "dist")
    total = arcs.join(ended, "slot").groupBy("feeder").agg((F.max("dist") + 1).alias("total"))
    both = arcs.join(ended, "slot").join(ended.select(F.col("slot").alias("back"), F.col("dist").alias("__back")), "back").where("dist > __back")
    down = both.join(total, "feeder").select(
        "feeder", F.col("to").alias("node"), F.col("at").alias("parent"), (F.col("total") - F.col("dist")).alias("enter"),
        F.expr("(dist - __back + 1) div 2").alias("size"))
    placed = global_rank(down, [F.col("enter")], partition=["feeder"], out="place")
    roots = total.join(sources, "feeder").select(
        "feeder", F.col("source").alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place"), F.expr("total div 2 + 1").alias("size"))
    return stage(placed.select(
        "feeder", "node", "parent", (2 * F.col("place") - F.col("enter")).cast("int").alias("depth"), F.col("place").cast("long").alias("place"), "size",
    ).unionByName(roots, allowMissingColumns=True), "tour")


def jump_levels(tree: DataFrame) -> list[DataFrame]:
    """Staged ``(feeder, node, jump)`` per level; level k holds the nodes with a 2^k-th ancestor, which is ``jump``.

    Depths tell which nodes go on, and one aggregate the number of levels.
    """
    level = stage(tree.where(F.col("parent").isNotNull()).select("feeder", "node", F.col("parent").alias("jump"), "depth"), "jump")
    rounds = (level.agg(F.max("depth")).first()[0] or 0).bit_length()
    levels: list[DataFrame] = []
    while len(levels) < rounds:
        levels.append(level)
        if len(levels) < rounds:
            up = level.select("feeder", F.col("node").alias("jump"), F.col("jump").alias("__next"))
            level = stage(level.where(F.col("depth") >= 2 ** len(levels)).join(up, ["feeder", "jump"]).select(
                "feeder", "node", F.col("__next").alias("jump"), "depth"), "jump")
    return [lv.select("feeder", "node", "jump") for lv in levels]


def _lowest(acc: DataFrame, levels: Sequence[DataFrame], down: bool) -> DataFrame:
    """Least ``w`` of each node's subtree (``down``), or of the node and its ancestors. A level may count a node twice."""
    for level in levels:
        if down:
            more = level.join(acc, ["feeder", "node"]).groupBy("feeder", F.col("jump").alias("node")).agg(F.min("w").alias("__w"))
        else:
            more = level.join(acc.select("feeder", F.col("node").alias("jump"), F.col("w").alias("__w")), ["feeder", "jump"]).drop("jump")
        acc = stage(acc.join(more, ["feeder", "node"], "left").select("feeder", "node", F.least("w", "__w").alias("w")), "least")
    return acc


def _shorten(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """``feeder, node, depth``: breadth-first depths from those of a spanning tree.

    The walk to a node goes up its tree path from where it left the last chord, so its length is depth(v) plus the least
    of least(depth + d below a) - 2 depth(a) over the ancestors a. A round takes one more chord into account.
    """
    known = tree.select("feeder", "node", "depth")
    a, b = known.select("feeder", F.col("node").alias("a"), F.col("depth").alias("__da")), known.select("feeder", F.col("node").alias("b"), F.col("depth").alias("__db"))
    in_tree = tree.where("parent is not null").select("feeder", F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
    chords = stage(pairs.join(in_tree, ["feeder", "a", "b"], "left_anti").join(a, ["feeder", "a"], "left_semi").join(b, ["feeder", "b"], "left_semi"), "chords")
    best = known.withColumn("d", F.col("depth"))
    if chords.isEmpty():
        return best.select("feeder", "node", F.col("d").alias("depth"))
    levels = jump_levels(tree)
    while True:
        ends = chords.select("feeder", F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        reach = ends.join(best.select("feeder", F.col("node").alias("a"), (F.col("d") + 1).alias("__d")), ["feeder", "a"]).groupBy(
            "feeder", F.col("b").alias("node")).agg(F.min("__d").alias("__d"))
        nearer = stage(best.join(reach, ["feeder", "node"]).where("__d < d").select("feeder", "node", "__d"), "nearer")
        if nearer.isEmpty():
            return best.select("feeder", "node", F.col("d").alias("depth"))
        now = best.join(nearer, ["feeder", "node"], "left").withColumn("d", F.coalesce("__d", "d")).drop("__d")
        below = _lowest(stage(now.select("feeder", "node", (F.col("d") + F.col("depth")).alias("w")), "least"), levels, down=True)
        turn = stage(below.join(known, ["feeder", "node"]).select("feeder", "node", (F.col("w") - 2 * F.col("depth")).alias("w")), "least")
        best = stage(known.join(_lowest(turn, levels, down=False), ["feeder", "node"]).select("feeder", "node", "depth", (F.col("depth") + F.col("w")).alias("d")), "depths")


def _orient_large(edges: DataFrame, sources: DataFrame) -> DataFrame:
    pairs = stage(_ends_of(edges), "pairs")
    tree = euler_tour(spanning_forest(pairs), sources)
    depth = stage(_shorten(tree, pairs), "depths")
    both = edges.select("feeder", F.inline(F.array(*[
        F.struct(F.col(x).alias("parent"), F.col(y).alias("node"), F.col("segment_id"), F.coalesce("length_km", F.lit(0.0)).alias("length_km"))
        for x, y in (("from_node", "to_node"), ("to_node", "from_node"))])))
    above = depth.select("feeder", F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"))
    chosen = stage(both.join(above, ["feeder", "parent"]).join(depth, ["feeder", "node", "depth"]).groupBy("feeder", "node").agg(
        F.min(F.struct("parent", "segment_id", "length_km")).alias("m")).select("feeder", "node", "m.*"), "chosen")
    changed = tree.join(chosen.select("feeder", "node", F.col("parent").alias("__p")), ["feeder", "node"]).where("parent <> __p")
    if not changed.isEmpty():
        tree = euler_tour(chosen.select("feeder", F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b")), sources)
    return tree.join(chosen.drop("parent"), ["feeder", "node"], "left").fillna({"length_km": 0.0}).select(*TREE)


def orient_tours(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``TREE`` of every feeder that holds its source; nodes that no path joins to it are absent.

    A node's parent is the smallest neighbour nearer to the source. Of several sources of a feeder the smallest counts.
    """
    one = sources.groupBy("feeder").agg(F.min("source").alias("source"))
    edges = edges.select("feeder", "segment_id", "from_node", "to_node", F.col("length_km").cast("double").alias("length_km"))
    large = stage(edges.groupBy("feeder").count().where(F.col("count") > PIECE).select("feeder"), "large")
    kind = {f.name: f.dataType.simpleString() for f in edges.schema}
    schema = f"feeder {kind['feeder']}, node {kind['from_node']}, parent {kind['from_node']}, segment_id {kind['segment_id']}, length_km double, depth int, place long, size long"
    if large.isEmpty():
        return edges.groupBy("feeder").cogroup(one.groupBy("feeder")).applyInPandas(lambda e, s: _orient_feeder(e, s), schema)
    small = edges.join(large, "feeder", "left_anti")
    tree = small.groupBy("feeder").cogroup(one.groupBy("feeder")).applyInPandas(lambda e, s: _orient_feeder(e, s), schema)
    return tree.unionByName(_orient_large(stage(edges.join(large, "feeder", "left_semi"), "edges"), one.join(large, "feeder", "left_semi")))


# --- sums in tour order -----------------------------------------------------------

def in_blocks(tree: DataFrame) -> DataFrame:
    """Adds ``stop`` (the place after the subtree) and ``block`` (its range of places)."""
    return tree.withColumns({"stop": F.col("place") + F.col("size"), "block": F.expr(f"place div {BLOCK}")})


def _prefixes(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``__<c>``: the sum of each column over the places up to and with the row's own in its feeder."""
    upto = Window.partitionBy("feeder", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"__{c}": F.sum(c).over(upto) for c in columns})
    # One row a range: the offsets of a feeder's ranges.
    before = Window.partitionBy("feeder").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("feeder", "block").agg(*[F.sum(c).alias(c) for c in columns])
    offsets = totals.select("feeder", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"__before_{c}") for c in columns])
    return local.join(offsets, ["feeder", "block"]).withColumns({f"__{c}": F.col(f"__{c}") + F.col(f"__before_{c}") for c in columns}).drop(
        *[f"__before_{c}" for c in columns])


def subtree_totals(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` (of ``in_blocks``) with each column replaced by its sum over the node's subtree.

    The sum over the places [place, stop) is the prefix before ``stop`` less that before ``place``.
    """
    summed = _prefixes(rows, columns)
    ends = summed.select("feeder", (F.col("place") + 1).alias("stop"), *[F.col(f"__{c}").alias(f"__end_{c}") for c in columns])
    return summed.join(ends, ["feeder", "stop"]).withColumns(
        {c: F.col(f"__end_{c}") - F.col(f"__{c}") + F.col(c) for c in columns}).drop(*[f"__{c}" for c in columns], *[f"__end_{c}" for c in columns])


def path_totals(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` (of ``in_blocks``) with each column replaced by its sum over the node and its ancestors.

    The ancestors of a place are the nodes entered up to it and not left yet: what a node adds at its place is taken off
    again at its ``stop``.
    """
    left = rows.groupBy("feeder", F.col("stop").alias("place")).agg(*[F.sum(c).alias(f"__off_{c}") for c in columns])
    net = rows.join(left, ["feeder", "place"], "left").withColumns({f"__net_{c}": F.col(c) - F.coalesce(f"__off_{c}", F.lit(0.0)) for c in columns})
    nets = [f"__net_{c}" for c in columns]
    summed = _prefixes(net.drop(*[f"__off_{c}" for c in columns]), nets)
    return summed.withColumns({c: F.col(f"____net_{c}") for c in columns}).drop(*nets, *[f"__{n}" for n in nets])
