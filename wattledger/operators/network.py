"""Radial networks of every feeder at once, as DataFrames keyed by (feeder, node).

``operators.tours`` roots the trees and numbers their nodes in tour order, so that
sums over subtrees and paths are prefix sums, and nearest-ancestor questions one
sweep over ranges of places. Traces take pointer doubling: ``jump_levels`` keeps, per
level k, each node's 2^k-th ancestor.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.operators.tours import BLOCK, in_blocks, jump_levels, orient_tours, path_totals
from wattledger.staging import stage

KEY = ["feeder", "node"]


def infer_source(edges: DataFrame) -> DataFrame:
    """``(feeder, source)``: smallest from-node that is never a to-node."""
    heads = edges.select("feeder", F.col("from_node").alias("source"))
    tails = edges.select("feeder", F.col("to_node").alias("source")).distinct()
    return heads.join(tails, ["feeder", "source"], "left_anti").groupBy("feeder").agg(F.min("source").alias("source"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select("feeder", F.explode(F.array("from_node", "to_node")).alias("node")).distinct()


def _innermost(rows: pd.DataFrame) -> pd.DataFrame:
    """Place of the innermost range open at each node, -1 where none is. Ranges nest, so the last one opened is it."""
    rows = rows.sort_values(["place", "is_node"], kind="stable")
    places, stops, above = [], [], []
    for place, stop, is_node in zip(rows["place"].tolist(), rows["stop"].tolist(), rows["is_node"].tolist()):
        while stops and stops[-1] <= place:
            places.pop()
            stops.pop()
        if is_node:
            above.append(places[-1] if places else -1)
        else:
            places.append(place)
            stops.append(stop)
    return rows.loc[rows["is_node"], ["feeder", "node"]].assign(above=above)


def nearest_ancestor(tree: DataFrame, levels: Sequence[DataFrame] | None, flagged: DataFrame, label: str, out: str) -> DataFrame:
    """``(feeder, node, out)``: ``label`` of the first flagged node upstream, the node itself included.

    A subtree is a range of places, so the answer is the innermost flagged range around a node's place. Ranges of places
    are swept by themselves; what is still open where one begins is carried to it: of the flagged subtrees that reach over
    it or end at the same place, the innermost. ``levels`` are not needed.
    """
    rows = in_blocks(tree.select(*KEY, "place", "size")).drop("size")
    marked = stage(rows.join(flagged.where(F.col(label).isNotNull()).select(*KEY, F.col(label).alias(out)), KEY).select(
        "feeder", "place", "stop", "block", F.expr(f"(stop - 1) div {BLOCK}").alias("last"), out), "marked")
    open_ = marked.where("last > block").groupBy("feeder", "block", "last", "stop").agg(F.max("place").alias("place"))
    ending = open_.groupBy("feeder", F.col("last").alias("block"), "stop").agg(F.max("place").alias("place"))
    over = open_.where("last > block + 1").groupBy("feeder", "block", "last").agg(F.max("place").alias("place")).select(
        "feeder", F.explode(F.expr("sequence(block + 1, last - 1)")).alias("block"), "place").groupBy("feeder", "block").agg(
        F.max("place").alias("place")).withColumn("stop", (F.col("block") + 1) * BLOCK)
    ranges = marked.select("feeder", "block", "place", "stop").distinct().unionByName(ending).unionByName(over)
    every = rows.withColumn("is_node", F.lit(True)).unionByName(ranges.withColumn("is_node", F.lit(False)), allowMissingColumns=True)
    kind = {f.name: f.dataType.simpleString() for f in tree.schema}
    placed = every.groupBy("feeder", "block").applyInPandas(_innermost, f"feeder {kind['feeder']}, node {kind['node']}, above long")
    found = marked.select("feeder", F.col("place").alias("above"), out)
    return stage(placed.join(found, ["feeder", "above"], "left").select(*KEY, out), "nearest")


def orient(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Tree of every feeder: ``feeder, node, parent, segment_id, length_km, depth, place, size``.

    Edges may point either way, form meshes or lie apart from the source; see ``operators.tours``. ``place`` and ``size``
    number the nodes in tour order. ``edges`` should be a staged or stored table.
    """
    return stage(orient_tours(edges, sources), "tree")


def islands(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Nodes that no path joins to the source."""
    return nodes_of(edges).join(tree.select(*KEY), KEY, "left_anti")


def cycle_test(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Per feeder: more edges between reached nodes than a tree would have?"""
    reached = tree.groupBy("feeder").agg(F.count(F.lit(1)).alias("nodes"))
    a = tree.select("feeder", F.col("node").alias("from_node"))
    b = tree.select("feeder", F.col("node").alias("to_node"))
    inner = edges.join(a, ["feeder", "from_node"], "left_semi").join(b, ["feeder", "to_node"], "left_semi")
    n = inner.groupBy("feeder").agg(F.count(F.lit(1)).alias("edges"))
    return reached.join(n, "feeder", "left").select(
        "feeder", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"),
        (F.coalesce("edges", F.lit(0)) > F.col("nodes") - 1).alias("has_cycle"))


def path_km(tree: DataFrame, levels: Sequence[DataFrame] | None = None) -> DataFrame:
    """Distance along the network from the source to every node. ``levels`` are not needed."""
    return path_totals(in_blocks(tree), ["length_km"]).select(*KEY, F.col("length_km").alias("path_km"))


def trace_upstream(tree: DataFrame, starts: DataFrame, levels: Sequence[DataFrame] | None = None) -> DataFrame:
    """Ancestors of the given nodes, themselves included: ``start, node, steps``.

    The output has one row per ancestor by definition, so it is asked for chosen
    nodes. A round doubles the steps gone: level k takes all ancestors found 2^k on.
    """
    found = stage(starts.select("feeder", F.col("node").alias("start"), "node", F.lit(0).alias("steps")).join(
        tree.select(*KEY), KEY, "left_semi").select("feeder", "start", "node", "steps"), "trace")
    for k, level in enumerate(levels or jump_levels(tree)):
        further = found.join(level, KEY).select("feeder", "start", F.col("jump").alias("node"), (F.col("steps") + 2 ** k).alias("steps"))
        found = stage(found.unionByName(further), "trace")
    return found


def relatives(tree: DataFrame) -> DataFrame:
    """Parent, number of children and depth per node."""
    kids = tree.where(F.col("parent").isNotNull()).groupBy("feeder", F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("children"))
    return tree.join(kids, KEY, "left").select(*KEY, "parent", F.coalesce("children", F.lit(0)).alias("children"), "depth")


def branches(tree: DataFrame, levels: Sequence[DataFrame] | None, min_nodes: int = 2) -> DataFrame:
    """``(feeder, node, branch)``: the branch that hangs from a network fork.

    A node forks only with two or more children that go on; a service drop does
    not fork. The branch is named after its first node, and a fork belongs to the
    branch that ends in it.
    """
    rel = stage(relatives(tree), "relatives")
    trunk = rel.where((F.col("children") > 0) & F.col("parent").isNotNull()).groupBy(
        "feeder", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("trunks"))
    forks = trunk.where(F.col("trunks") >= 2).select(*KEY).unionByName(
        rel.where(F.col("parent").isNull()).select(*KEY)).distinct()
    heads = rel.join(forks.withColumnRenamed("node", "parent"), ["feeder", "parent"], "left_semi").select(
        "feeder", "node", F.col("node").alias("head"))
    placed = nearest_ancestor(tree, levels, heads, "head", "branch").where(F.col("branch").isNotNull())
    sizes = placed.groupBy("feeder", "branch").agg(F.count(F.lit(1)).alias("__n"))
    leaf = rel.where(F.col("children") == 0).select("feeder", F.col("node").alias("branch"), F.lit(True).alias("__leaf"))
    kept = sizes.join(leaf, ["feeder", "branch"], "left").where(
        (F.col("__n") >= min_nodes) | F.coalesce("__leaf", F.lit(False))).select("feeder", "branch")
    return placed.join(kept, ["feeder", "branch"], "left_semi").select("feeder", "node", "branch")


def protection_zones(tree: DataFrame, levels: Sequence[DataFrame] | None, switches: DataFrame) -> DataFrame:
    """``(feeder, node, zone)``: nearest switch (or the source) upstream, itself included."""
    bounds = switches.select(*KEY).unionByName(tree.where(F.col("parent").isNull()).select(*KEY)).distinct()
    bounds = bounds.withColumn("z", F.col("node"))
    return nearest_ancestor(tree, levels, bounds, "z", "zone")


def network_km(tree: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """Length of the parent segments of each group of nodes."""
    return tree.join(groups, KEY).groupBy("feeder", by).agg(F.sum("length_km").alias("network_km"))


def assign_to_sites(tree: DataFrame, levels: Sequence[DataFrame] | None, sites: DataFrame) -> DataFrame:
    """``(feeder, node, site)``: first transformer site upstream of every node."""
    return nearest_ancestor(tree, levels, sites, "site", "site")


def lv_zones(sites: DataFrame, customers: DataFrame, lights: DataFrame, placement: DataFrame) -> DataFrame:
    """Energy and counts per transformer; individuals under a totaliser are not billed twice.

    ``customers``: feeder, node, energy_kwh, totaliser, under_totaliser.
    ``lights``: feeder, node, energy_kwh, metered, traffic.
    """
    where = placement.where(F.col("site").isNotNull())
    e = F.coalesce("energy_kwh", F.lit(0.0))
    total, under = F.coalesce("totaliser", F.lit(False)), F.coalesce("under_totaliser", F.lit(False))
    c = customers.join(where, KEY).groupBy("feeder", "site").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(F.when(total | ~under, e).otherwise(0.0)).alias("billed_kwh"),
        F.sum(F.when(total, e).otherwise(0.0)).alias("totaliser_kwh"),
        F.sum(F.when(under & ~total, e).otherwise(0.0)).alias("individuals_kwh"),
    )
    unbilled = F.col("traffic") | ~F.coalesce("metered", F.lit(False))
    l = lights.join(where, KEY).groupBy("feeder", "site").agg(
        F.sum(F.when(unbilled, e).otherwise(0.0)).alias("lighting_kwh"),
        F.count_if(unbilled & ~F.col("traffic")).alias("lights"), F.count_if("traffic").alias("traffic_lights"))
    out = sites.select("feeder", "site", "kva").join(c, ["feeder", "site"], "left").join(l, ["feeder", "site"], "left")
    numbers = ["customers", "billed_kwh", "totaliser_kwh", "individuals_kwh", "lighting_kwh", "lights", "traffic_lights"]
    return out.fillna(0, subset=numbers).withColumn(
        "totaliser_residual_kwh",
        F.when(F.col("totaliser_kwh") > 0, F.col("totaliser_kwh") - F.col("individuals_kwh")).otherwise(0.0))


# --- versions ----------------------------------------------------------------

# Stages to recompute when a hash changes.
STALE = {
    "topology": ["topologia", "flujo", "perdidas", "balance", "focalizacion"],
    "attribute": ["calidad", "flujo", "perdidas", "balance"],
    "switch": ["topologia_dinamica", "balance"],
}


def digest_rows(rows: DataFrame, content: Sequence[Column], name: str) -> DataFrame:
    """Order-free digest per feeder of any number of rows.

    Each row is hashed and the hashes are folded with two sums of 60-bit halves and
    a count, which combine on the map side: no feeder's rows are collected.
    """
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in content]), 256)
    half = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")
    folded = rows.groupBy("feeder").agg(
        F.sum(half(1)).alias("a"), F.sum(half(16)).alias("b"), F.count(F.lit(1)).alias("n"))
    return folded.select("feeder", F.substring(F.sha2(F.concat_ws("|", "a", "b", "n"), 256), 1, 16).alias(name))


def feeder_hashes(edges: DataFrame, sites: DataFrame, switches: DataFrame, sources: DataFrame) -> DataFrame:
    """Topology, attribute and switch-state hash per feeder, for change detection."""
    c = F.col
    topo = edges.select("feeder", F.concat_ws("|", "segment_id", "from_node", "to_node", F.round("length_km", 4).cast("string")).alias("r")).unionByName(
        sources.select("feeder", F.concat(F.lit("source|"), "source").alias("r")))
    attr = edges.select("feeder", F.concat_ws("|", "segment_id", F.coalesce("conductor", F.lit("")), "n_phases", "voltage_v").alias("r")).unionByName(
        sites.select("feeder", F.concat_ws("|", F.lit("site"), "site", "kva", "config", "phases").alias("r")))
    sw = switches.select("feeder", F.concat_ws("|", "node", "normal_pos", "current_pos").alias("r"))
    out = digest_rows(topo, [c("r")], "topology").join(digest_rows(attr, [c("r")], "attribute"), "feeder", "full_outer")
    return out.join(digest_rows(sw, [c("r")], "switch"), "feeder", "full_outer")


def element_counts(**tables: DataFrame) -> DataFrame:
    """Elements per feeder and kind."""
    out = None
    for kind, df in tables.items():
        n = df.groupBy("feeder").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        out = n if out is None else out.unionByName(n)
    return out


def register_versions(current: DataFrame, new: DataFrame) -> DataFrame:
    """What each feeder's load means: ALTA, ACTUALIZACION or SIN_CAMBIO, and what to recompute.

    ``current`` has the hashes with ``version``; ``new`` has the hashes.
    """
    kinds = list(STALE)
    old = current.select("feeder", "version", *[F.col(k).alias(f"__{k}") for k in kinds])
    j = new.join(old, "feeder", "left")
    changed = F.filter(F.array(*[
        F.when(~F.col(k).eqNullSafe(F.col(f"__{k}")), F.lit(k)) for k in kinds]), lambda x: x.isNotNull())
    known = F.col("version").isNotNull()
    stale = F.array_sort(F.array_distinct(F.flatten(F.array(*[
        F.when(~known | F.array_contains("changed", k), F.array(*[F.lit(s) for s in STALE[k]])).otherwise(
            F.array().cast("array<string>")) for k in kinds]))))
    return j.withColumn("changed", F.when(known, changed).otherwise(F.array().cast("array<string>"))).select(
        "feeder",
        F.when(~known, "ALTA").when(F.size("changed") > 0, "ACTUALIZACION").otherwise("SIN_CAMBIO").alias("action"),
        F.when(~known, 1).when(F.size("changed") > 0, F.col("version") + 1).otherwise(F.col("version")).alias("version"),
        "changed", stale.alias("stages"))


# --- quality -----------------------------------------------------------------

# Severity by rule.
SEVERITY = {"R05": "CRITICA", "R09": "ALTA", "R11": "ALTA", "R12": "CRITICA", "R15": "ALTA", "R22": "CRITICA",
            "R24": "CRITICA", "P01": "CRITICA", "P09": "ALTA"}


def quality_findings(
    edges: DataFrame, conductors: DataFrame, unreached: DataFrame, sites: DataFrame, *, currents: DataFrame | None = None,
    declared: DataFrame | None = None, traced: DataFrame | None = None,
) -> DataFrame:
    """Findings of the nine rules: ``feeder, rule, severity, element, value, limit``.

    An undeclared conductor (R12) silences the other segment rules. ``sites`` carry
    ``kva``, ``capacity_kva`` and ``units``.
    """
    none = F.lit(None).cast("double")
    def found(df: DataFrame, rule: str, element: str, value: Column = none, limit: Column = none) -> DataFrame:
        return df.select("feeder", F.lit(rule).alias("rule"), F.lit(SEVERITY[rule]).alias("severity"),
                         F.col(element).cast("string").alias("element"), value.cast("double").alias("value"), limit.cast("double").alias("limit"))
    cat = conductors.select(F.col("code").alias("conductor"), "ampacity_a", F.lit(True).alias("__known"))
    blank = F.coalesce(F.col("conductor") == "", F.lit(True))
    seg = edges.join(cat, "conductor", "left").withColumn("__blank", blank)
    named = seg.where(~F.col("__blank"))
    parts = [
        found(seg.where("__blank"), "R12", "segment_id"),
        found(named.where(F.col("__known").isNull()), "R05", "segment_id"),
        found(named.where((F.col("length_km") <= 0) | (F.col("length_km") > 5)), "R11", "segment_id", F.col("length_km"), F.lit(5.0)),
        found(unreached, "R22", "node"),
    ]
    if currents is not None:
        hot = named.join(currents, ["feeder", "segment_id"]).where(F.col("current_a") > F.col("ampacity_a"))
        parts.append(found(hot, "R09", "segment_id", F.col("current_a"), F.col("ampacity_a")))
    empty = sites.where(F.col("units") == 0)
    parts += [found(empty, "R24", "site"), found(empty, "P01", "site")]
    off = F.abs(F.col("kva") - F.col("capacity_kva")) / F.greatest("capacity_kva", F.lit(1e-9)) > 0.10
    parts.append(found(sites.where((F.col("units") > 0) & (F.col("kva") != 0) & off), "P09", "site", F.col("kva"), F.col("capacity_kva")))
    if declared is not None and traced is not None:
        d = declared.select("account", F.col("site").alias("__d"))
        moved = traced.where(F.col("site").isNotNull()).join(d, "account").where((F.col("__d") != "") & (F.col("__d") != F.col("site")))
        parts.append(found(moved, "R15", "account"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def findings_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("findings"))


def integrity(customers: DataFrame, units: DataFrame, sites: DataFrame, lines: DataFrame) -> DataFrame:
    """Customers without connection, units without site, lines with fewer than two vertices."""
    kind = lambda df, k, e: df.select(F.lit(k).alias("check"), F.col(e).cast("string").alias("element"))
    return (
        kind(customers.where(F.coalesce(F.trim("connection") == "", F.lit(True))), "CLIENTE_SIN_CONEXION", "account")
        .unionByName(kind(units.join(sites.select("site"), "site", "left_anti"), "UNIDAD_SIN_PUESTO", "unit"))
        .unionByName(kind(lines.where(F.coalesce(F.col("vertices") < 2, F.lit(True))), "LINEA_SIN_VERTICES", "segment_id"))
    )


def dependants(targets: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """Dependants per element and layer, for deciding whether it can be deleted."""
    out = None
    for layer, df in references.items():
        n = df.join(targets.select("element"), "element", "left_semi").groupBy("element").agg(
            F.count(F.lit(1)).alias("dependants")).withColumn("layer", F.lit(layer))
        out = n if out is None else out.unionByName(n)
    return out


def restrict_to_feeders(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of an element table whose node belongs to the given nodes."""
    return elements.join(nodes.select(*KEY).distinct(), KEY, "left_semi")


def bind_in_order(accounts: DataFrame, slots: DataFrame) -> DataFrame:
    """Pair accounts with network slots by their order (fixtures without real links)."""
    from wattledger.operators.ranking import global_rank

    a = global_rank(accounts.select("account"), [F.col("account")], out="pos")
    s = global_rank(slots.select("feeder", "node"), [F.col("feeder"), F.col("node")], out="pos")
    return a.join(s, "pos").drop("pos")
