"""Networks, losses, loading and load flow over a network derived from ``customer``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions import electric
from wattledger.operators import balance, losses, network, powerflow, signals, tours
from wattledger.operators.rangejoin import catalogue_nearest
from wattledger.params import TARIFF_CLASSES, Lighting
from wattledger.plans.grid import GridPlan, analyse_grid
from wattledger.registry.core import cte, query
from wattledger.registry.customers import rounded
from wattledger.registry.energy import orders_by_account
from wattledger.registry.inputs import code, table
from wattledger.sources import network_tables
from wattledger.staging import stage

FEEDERS = 20


def node_name(g: Column, j: Column) -> Column:
    return F.concat(code("N", g, 2), F.lit("-"), F.lpad(j.cast("string"), 7, "0"))


def _node_sql(g: str, j: str) -> str:
    return f"'N' || lpad(CAST({g} AS VARCHAR), 2, '0') || '-' || lpad(CAST({j} AS VARCHAR), 7, '0')"


def grid_nodes(spark, d) -> DataFrame:
    """One node per customer: 20 feeders, each a tree with parent (2(j-1)) div 3."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("k"), (k % FEEDERS).alias("g"), F.floor(k / FEEDERS).alias("j")).select(
        "k", "g", "j", code("G", F.col("g"), 2).alias("feeder"), node_name(F.col("g"), F.col("j")).alias("node"),
        node_name(F.col("g"), F.floor((F.col("j") - 1) * 2 / 3)).alias("up"))


cte("gnodes", f"""
SELECT *, 'G' || lpad(CAST(g AS VARCHAR), 2, '0') AS feeder, {_node_sql('g', 'j')} AS node, {_node_sql('g', '(j - 1) * 2 // 3')} AS up
FROM (SELECT c_custkey AS k, c_custkey % 20 AS g, c_custkey // 20 AS j FROM customer)
""")


def edges(spark, d) -> DataFrame:
    """Tree edges; feeder 3 has reversed ones, feeder 4 a mesh, feeder 5 an island."""
    n = grid_nodes(spark, d)
    k, g, j = F.col("k"), F.col("g"), F.col("j")
    flip = (g == 3) & (j % 5 == 0)
    tree = n.where((j > 0) & ~((g == 5) & (j == 50))).select(
        "feeder", code("S", k, 9).alias("segment_id"),
        F.when(flip, F.col("node")).otherwise(F.col("up")).alias("from_node"),
        F.when(flip, F.col("up")).otherwise(F.col("node")).alias("to_node"), "k")
    mesh = n.where((g == 4) & (j == 9)).select(
        "feeder", code("M", k, 9).alias("segment_id"), node_name(g, F.lit(5)).alias("from_node"), F.col("node").alias("to_node"), "k")
    return stage(tree.unionByName(mesh).select(
        "feeder", "segment_id", "from_node", "to_node",
        (F.lit(0.05) + (k % 10) / 100).alias("length_km"),
        F.when(k % 23 != 0, F.concat(F.lit("C"), (k % 5).cast("string"))).alias("conductor"),
        F.when(k % 3 == 0, 1).otherwise(3).alias("n_phases"), F.lit(13800.0).alias("voltage_v")), "edges")


cte("gedges", f"""
SELECT feeder, segment_id, from_node, to_node, 0.05 + (k % 10) / 100.0::DOUBLE AS length_km, CASE WHEN k % 23 <> 0 THEN 'C' || (k % 5) END AS conductor,
  CASE WHEN k % 3 = 0 THEN 1 ELSE 3 END AS n_phases FROM (
  SELECT feeder, k, 'S' || lpad(CAST(k AS VARCHAR), 9, '0') AS segment_id, CASE WHEN g = 3 AND j % 5 = 0 THEN node ELSE up END AS from_node,
    CASE WHEN g = 3 AND j % 5 = 0 THEN up ELSE node END AS to_node FROM gnodes WHERE j > 0 AND NOT (g = 5 AND j = 50)
  UNION ALL SELECT feeder, k, 'M' || lpad(CAST(k AS VARCHAR), 9, '0'), {_node_sql('g', '5')}, node FROM gnodes WHERE g = 4 AND j = 9)
""")
cte("gadj", """
SELECT feeder, from_node AS a, to_node AS b, segment_id, length_km FROM gedges UNION ALL SELECT feeder, to_node, from_node, segment_id, length_km FROM gedges
""")
cte("rec_walk", """
SELECT feeder, node, 0 AS depth, [node] AS path FROM gnodes WHERE j = 0
UNION ALL SELECT w.feeder, e.b, w.depth + 1, list_append(w.path, e.b) FROM rec_walk w JOIN gadj e ON e.feeder = w.feeder AND e.a = w.node WHERE NOT list_contains(w.path, e.b)
""")
cte("gdepth", "SELECT feeder, node, min(depth) AS depth FROM rec_walk GROUP BY 1, 2")
cte("gtree", """
SELECT d.feeder, d.node, d.depth, CASE WHEN d.depth > 0 THEN min(e.a) END AS parent, CASE WHEN d.depth > 0 THEN min_by(e.segment_id, (e.a, e.segment_id)) END AS segment_id,
  CASE WHEN d.depth > 0 THEN min_by(e.length_km, (e.a, e.segment_id)) ELSE 0 END AS length_km
FROM gdepth d LEFT JOIN (SELECT x.*, p.depth AS pd FROM gadj x JOIN gdepth p ON p.feeder = x.feeder AND p.node = x.a) e ON e.feeder = d.feeder AND e.b = d.node AND e.pd = d.depth - 1
GROUP BY 1, 2, 3
""")
cte("rec_closure", """
SELECT feeder, node, node AS anc, 0 AS steps FROM gtree
UNION ALL SELECT c.feeder, c.node, t.parent, c.steps + 1 FROM rec_closure c JOIN gtree t ON t.feeder = c.feeder AND t.node = c.anc WHERE t.parent IS NOT NULL
""")


def sources(spark, d) -> DataFrame:
    return grid_nodes(spark, d).where(F.col("j") == 0).select("feeder", F.col("node").alias("source"))


def _tree(spark, d):
    e = edges(spark, d)
    return e, network.orient(e, sources(spark, d))


def walk(spark, d):
    """Edges and tree; the jump levels are left to those that trace."""
    return *_tree(spark, d), None


@query("feeder_sources", """
SELECT feeder, min(from_node) AS source FROM gedges e WHERE NOT EXISTS (SELECT 1 FROM gedges x WHERE x.feeder = e.feeder AND x.to_node = e.from_node) GROUP BY 1
""")
def _(spark, d):
    return network.infer_source(edges(spark, d))


@query("network_tree", "SELECT feeder, node, parent, segment_id, round(length_km, 6) AS length_km, CAST(depth AS INTEGER) AS depth FROM gtree")
def _(spark, d):
    return rounded(_tree(spark, d)[1].drop("place", "size"), length_km=6)


@query("network_islands", """
SELECT feeder, node FROM (SELECT feeder, from_node AS node FROM gedges UNION SELECT feeder, to_node FROM gedges) EXCEPT SELECT feeder, node FROM gtree
""")
def _(spark, d):
    return network.islands(*_tree(spark, d))


@query("network_cycles", """
SELECT t.feeder, t.nodes, coalesce(e.n, 0) AS edges, coalesce(e.n, 0) > t.nodes - 1 AS has_cycle FROM (SELECT feeder, count(*) AS nodes FROM gtree GROUP BY 1) t
LEFT JOIN (SELECT feeder, count(*) AS n FROM gedges g WHERE EXISTS (SELECT 1 FROM gtree x WHERE x.feeder = g.feeder AND x.node = g.from_node)
  AND EXISTS (SELECT 1 FROM gtree x WHERE x.feeder = g.feeder AND x.node = g.to_node) GROUP BY 1) e USING (feeder)
""")
def _(spark, d):
    return network.cycle_test(*_tree(spark, d))


@query("path_to_source", """
SELECT c.feeder, c.node, round(sum(t.length_km), 6) AS path_km FROM rec_closure c JOIN gtree t ON t.feeder = c.feeder AND t.node = c.anc GROUP BY 1, 2
""")
def _(spark, d):
    return rounded(network.path_km(_tree(spark, d)[1]), path_km=6)


@query("trace_upstream", """
SELECT c.feeder, c.node AS start, c.anc AS node, CAST(c.steps AS INTEGER) AS steps FROM rec_closure c JOIN (
  SELECT feeder, max(node) AS node FROM gtree GROUP BY 1) m ON m.feeder = c.feeder AND m.node = c.node
""")
def _(spark, d):
    _, t, lv = walk(spark, d)
    return network.trace_upstream(t, t.groupBy("feeder").agg(F.max("node").alias("node")), lv)


cte("account_kwh", "SELECT o_custkey AS k, floor(sum(floor(o_totalprice / 100)) / 80) AS kwh FROM orders GROUP BY 1")
cte("gload", "SELECT n.*, coalesce(a.kwh, 0) AS kwh FROM gnodes n LEFT JOIN account_kwh a USING (k)")


def node_customers(spark, d) -> DataFrame:
    a = orders_by_account(spark, d).select(F.col("o_custkey").alias("k"), F.floor(F.col("total") / 80).cast("double").alias("kwh"))
    return grid_nodes(spark, d).join(a, "k", "left").select(
        "feeder", "node", F.col("k").alias("account"), F.coalesce("kwh", F.lit(0.0)).alias("energy_kwh"),
        (F.col("k") % 8 + 0).cast("int").alias("phase"), (F.col("k") % 40 == 0).alias("totaliser"), (F.col("k") % 40 == 20).alias("under_totaliser"),
        F.when(F.col("k") % 3 == 0, "Electrónico").when(F.col("k") % 3 == 1, "Inteligente").otherwise("Otro").alias("meter_type"), "j", "g")


@query("subtree_energy", """
SELECT c.feeder, c.anc AS node, count(*) AS customers, sum(g.kwh) AS energy_kwh FROM rec_closure c JOIN gload g ON g.node = c.node GROUP BY 1, 2
""")
def _(spark, d):
    t = _tree(spark, d)[1]
    c = node_customers(spark, d).groupBy("feeder", "node").agg(F.count(F.lit(1)).cast("double").alias("customers"), F.sum("energy_kwh").alias("energy_kwh"))
    v = tours.in_blocks(t).join(c, ["feeder", "node"], "left").fillna(0.0)
    out = tours.subtree_totals(v, ["customers", "energy_kwh"])
    # Energies are whole numbers, so their prefix sums are exact.
    return out.select("feeder", "node", F.col("customers").cast("bigint").alias("customers"), "energy_kwh")


@query("node_relatives", """
SELECT t.feeder, t.node, t.parent, count(c.node) AS children, CAST(t.depth AS INTEGER) AS depth FROM gtree t LEFT JOIN gtree c ON c.feeder = t.feeder AND c.parent = t.node GROUP BY 1, 2, 3, 5
""")
def _(spark, d):
    return network.relatives(_tree(spark, d)[1])


def transformer_sites(spark, d) -> DataFrame:
    k = F.col("k")
    n = grid_nodes(spark, d).where(F.col("j") % 4 == 1)
    kvas = F.when(k % 9 == 0, F.array().cast("array<double>")).when(k % 2 == 0, F.array((15 + (k % 4) * 10).cast("double"))).otherwise(
        F.array((15 + (k % 4) * 10).cast("double"), F.lit(25.0), F.lit(25.0)))
    return n.select(
        "feeder", "node", code("T", k, 7).alias("site"), F.when(k % 2 == 0, (15 + (k % 4) * 10).cast("double")).otherwise(F.lit(75.0)).alias("kva"),
        kvas.alias("kvas"), F.when(k % 2 == 0, "UNIDAD_SIMPLE").otherwise("BANCO_3").alias("config"),
        F.when(k % 2 == 0, 1).otherwise(3).alias("phases"), F.lit("BT").alias("voltage_class"))


cte("gsites", """
SELECT feeder, node, k, 'T' || lpad(CAST(k AS VARCHAR), 7, '0') AS site, CASE WHEN k % 2 = 0 THEN 15 + (k % 4) * 10 ELSE 75 END::DOUBLE AS kva,
  CASE WHEN k % 9 = 0 THEN [] WHEN k % 2 = 0 THEN [(15 + (k % 4) * 10)::DOUBLE] ELSE [(15 + (k % 4) * 10)::DOUBLE, 25, 25] END AS kvas,
  CASE WHEN k % 2 = 0 THEN 'UNIDAD_SIMPLE' ELSE 'BANCO_3' END AS config, CASE WHEN k % 2 = 0 THEN 1 ELSE 3 END AS phases FROM gnodes WHERE j % 4 = 1
""")
cte("gplace", """
SELECT c.feeder, c.node, min_by(s.site, c.steps) AS site FROM rec_closure c LEFT JOIN gsites s ON s.feeder = c.feeder AND s.node = c.anc GROUP BY 1, 2
""")
cte("gplaced", """
SELECT t.feeder, t.node, p.site FROM gtree t LEFT JOIN (SELECT c.feeder, c.node, min_by(s.site, c.steps) AS site FROM rec_closure c JOIN gsites s ON s.feeder = c.feeder AND s.node = c.anc GROUP BY 1, 2) p
  ON p.feeder = t.feeder AND p.node = t.node
""")


@query("customer_site", "SELECT g.k AS account, p.site FROM gplaced p JOIN gnodes g ON g.node = p.node")
def _(spark, d):
    _, t, lv = walk(spark, d)
    p = network.assign_to_sites(t, lv, transformer_sites(spark, d))
    return grid_nodes(spark, d).join(p, ["feeder", "node"]).select(F.col("k").alias("account"), "site")


cte("gkids", "SELECT t.feeder, t.node, t.parent, (SELECT count(*) FROM gtree c WHERE c.feeder = t.feeder AND c.parent = t.node) AS kids FROM gtree t")
cte("gforks", """
SELECT feeder, parent AS node FROM gkids WHERE kids > 0 AND parent IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2 UNION SELECT feeder, node FROM gtree WHERE parent IS NULL
""")
cte("gbranch", """
SELECT c.feeder, c.node, min_by(c.anc, c.steps) AS branch FROM rec_closure c JOIN gtree t ON t.feeder = c.feeder AND t.node = c.anc
JOIN gforks f ON f.feeder = t.feeder AND f.node = t.parent GROUP BY 1, 2
""")
cte("gbranches", """
SELECT feeder, node, branch FROM (SELECT b.*, count(*) OVER (PARTITION BY b.feeder, branch) AS n, k.kids FROM gbranch b JOIN gkids k ON k.feeder = b.feeder AND k.node = b.branch) WHERE n >= 2 OR kids = 0
""")


@query("network_branches", "SELECT * FROM gbranches")
def _(spark, d):
    _, t, lv = walk(spark, d)
    return network.branches(t, lv)


@query("branch_km", """
SELECT b.feeder, b.branch, round(sum(t.length_km), 6) AS network_km FROM gbranches b JOIN gtree t ON t.feeder = b.feeder AND t.node = b.node GROUP BY 1, 2
""")
def _(spark, d):
    _, t, lv = walk(spark, d)
    return rounded(network.network_km(t, network.branches(t, lv), "branch"), network_km=6)


def switches(spark, d) -> DataFrame:
    return grid_nodes(spark, d).where(F.col("j") % 11 == 3).select(
        "feeder", "node", F.lit("CERRADO").alias("normal_pos"), F.when(F.col("k") % 2 == 0, "ABIERTO").otherwise("CERRADO").alias("current_pos"))


cte("gzones", """
SELECT c.feeder, c.node, min_by(c.anc, c.steps) AS zone FROM rec_closure c JOIN gnodes g ON g.node = c.anc WHERE g.j % 11 = 3 OR g.j = 0 GROUP BY 1, 2
""")


@query("protection_zones", "SELECT * FROM gzones")
def _(spark, d):
    _, t, lv = walk(spark, d)
    return network.protection_zones(t, lv, switches(spark, d))


def lamps(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    nodes = grid_nodes(spark, d)
    count = F.broadcast(nodes.agg(F.max("k").alias("nodes")))  # one row; keys run from 1, so every part has a node
    raw = p.crossJoin(count).withColumn("k", (F.col("p_partkey") - 1) % F.col("nodes") + 1).join(nodes, "k").select(
        "feeder", "node", (50.0 + F.col("p_size")).alias("lamp_w"),
        F.when(F.col("p_type") == "SMALL", "LED").when(F.col("p_type") == "LARGE", "Sodio").when(F.col("p_type") == "PROMO", "Inducción").otherwise(F.col("p_type")).alias("technology"),
        (8 + F.col("p_size") % 8).cast("double").alias("hours"), F.lit(30.0).alias("days"), (F.col("p_size") % 3 == 0).alias("metered"),
        (F.col("p_size") % 10 == 1).alias("traffic"))
    return losses.luminaire_energy(raw, Lighting())


cte("glamps", """
SELECT *, (lamp_w + CASE technology WHEN 'LED' THEN 4 WHEN 'Sodio' THEN 25 WHEN 'Inducción' THEN 8 ELSE 20 END) * least(greatest(hours, 10), 13) * 30 / 1000 AS energy_kwh,
  NOT hours BETWEEN 10 AND 13 AS hours_clamped FROM (
  SELECT feeder, node, 50.0::DOUBLE + p_size AS lamp_w, CASE p_type WHEN 'SMALL' THEN 'LED' WHEN 'LARGE' THEN 'Sodio' WHEN 'PROMO' THEN 'Inducción' ELSE p_type END AS technology,
    (8 + p_size % 8)::DOUBLE AS hours, p_size % 3 = 0 AS metered, p_size % 10 = 1 AS traffic FROM part JOIN gnodes ON (p_partkey - 1) % (SELECT max(c_custkey) FROM customer) + 1 = k)
""")


@query("street_lighting", """
SELECT technology, round(coalesce(sum(energy_kwh) FILTER (WHERE metered), 0), 4) AS metered_kwh, round(coalesce(sum(energy_kwh) FILTER (WHERE NOT metered), 0), 4) AS unmetered_kwh,
  count(*) FILTER (WHERE hours_clamped) AS clamped FROM glamps GROUP BY 1
""")
def _(spark, d):
    return rounded(losses.lighting_summary(lamps(spark, d)), metered_kwh=4, unmetered_kwh=4)


cte("gzone_lv", """
SELECT s.feeder, s.site, s.kva, s.kvas, s.config, s.phases, coalesce(c.customers, 0) AS customers, coalesce(c.billed, 0) AS billed_kwh, coalesce(c.tot, 0) AS totaliser_kwh, coalesce(c.ind, 0) AS individuals_kwh,
  coalesce(l.e, 0) AS lighting_kwh, coalesce(l.n, 0) AS lights, coalesce(l.t, 0) AS traffic_lights, CASE WHEN coalesce(c.tot, 0) > 0 THEN c.tot - c.ind ELSE 0 END AS totaliser_residual_kwh
FROM gsites s LEFT JOIN (SELECT p.feeder, p.site, count(*) AS customers, sum(CASE WHEN k % 40 = 20 THEN 0 ELSE kwh END) AS billed, sum(CASE WHEN k % 40 = 0 THEN kwh ELSE 0 END) AS tot,
    sum(CASE WHEN k % 40 = 20 THEN kwh ELSE 0 END) AS ind FROM gplaced p JOIN gload g ON g.node = p.node WHERE p.site IS NOT NULL GROUP BY 1, 2) c USING (feeder, site)
LEFT JOIN (SELECT p.feeder, p.site, sum(CASE WHEN traffic OR NOT metered THEN energy_kwh ELSE 0 END) AS e, count(*) FILTER (WHERE NOT traffic AND NOT metered) AS n, count(*) FILTER (WHERE traffic) AS t
  FROM gplaced p JOIN glamps g ON g.node = p.node WHERE p.site IS NOT NULL GROUP BY 1, 2) l USING (feeder, site)
""")


def lv(spark, d, place: DataFrame | None = None, customers: DataFrame | None = None) -> DataFrame:
    """Low-voltage zones; ``place`` and ``customers`` if they are staged already."""
    sites = transformer_sites(spark, d)
    if place is None:
        _, t, lv_ = walk(spark, d)
        place = network.assign_to_sites(t, lv_, sites)
    return network.lv_zones(sites, customers or node_customers(spark, d), lamps(spark, d), place)


@query("lv_zones", """
SELECT feeder, site, kva, customers, billed_kwh, totaliser_kwh, individuals_kwh, round(lighting_kwh, 4) AS lighting_kwh, lights, traffic_lights, totaliser_residual_kwh FROM gzone_lv
""")
def _(spark, d):
    return rounded(lv(spark, d), lighting_kwh=4)


@query("totaliser_balance", """
SELECT site, totaliser_kwh - individuals_kwh AS residual_kwh, round(CASE WHEN totaliser_kwh > 0 THEN greatest(0, least(1, (totaliser_kwh - individuals_kwh) / totaliser_kwh)) ELSE 0 END, 6) AS n3 FROM gzone_lv
""")
def _(spark, d):
    r, s = signals.totaliser_balance(F.col("totaliser_kwh"), F.col("individuals_kwh"))
    return lv(spark, d).select("site", r.alias("residual_kwh"), F.round(s, 6).alias("n3"))


# --- catalogues and transformers ----------------------------------------------

# A short transformer catalogue for the queries.
SPECS = [
    dict(kva=15.0, phases=1, cls="BT", p0_kw=0.05, pk_kw=0.195), dict(kva=37.5, phases=1, cls="BT", p0_kw=0.105, pk_kw=0.39),
    dict(kva=50.0, phases=1, cls="BT", p0_kw=0.135, pk_kw=0.51), dict(kva=75.0, phases=3, cls="BT", p0_kw=0.33, pk_kw=1.03),
    dict(kva=150.0, phases=3, cls="MT", p0_kw=0.53, pk_kw=1.87),
]
cte("gspecs", """
SELECT * FROM (VALUES (0, 15.0::DOUBLE, 1, 'BT', 0.05::DOUBLE, 0.195::DOUBLE), (1, 37.5, 1, 'BT', 0.105, 0.39), (2, 50.0, 1, 'BT', 0.135, 0.51), (3, 75.0, 3, 'BT', 0.33, 1.03), (4, 150.0, 3, 'MT', 0.53, 1.87)) t(ord, kva, phases, cls, p0_kw, pk_kw)
""")


@query("nearest_transformer_spec", """
SELECT p_partkey, (SELECT min_by(s.kva, (CASE WHEN s.phases = 1 + 2 * (p_partkey % 2) AND s.cls = CASE WHEN p_size > 25 THEN 'MT' ELSE 'BT' END THEN 0 WHEN s.phases = 1 + 2 * (p_partkey % 2) THEN 1 ELSE 2 END, abs(s.kva - p_size * 3), ord)) FROM gspecs s) AS spec_kva FROM part
""")
def _(spark, d):
    p = table(spark, d, "part").select(
        "p_partkey", (F.col("p_size") * 3).cast("double").alias("kva"), (1 + 2 * (F.col("p_partkey") % 2)).cast("int").alias("phases"),
        F.when(F.col("p_size") > 25, "MT").otherwise("BT").alias("voltage_class"))
    return catalogue_nearest(p, SPECS).select("p_partkey", F.col("spec.kva").alias("spec_kva"))


cte("gtx", """
SELECT z.*, s.p0_kw, s.pk_kw, (0.0002 * billed_kwh + 0.03 * sqrt(billed_kwh)) / 0.92 AS s_max_kva,
  CASE WHEN len(kvas) = 0 THEN NULL WHEN config = 'BANCO_3' THEN 3 * list_sum(kvas) / len(kvas) ELSE kvas[1] END AS capacity_kva
FROM gzone_lv z JOIN gspecs s ON s.ord = (SELECT min_by(x.ord, (CASE WHEN x.phases = z.phases AND x.cls = 'BT' THEN 0 WHEN x.phases = z.phases THEN 1 ELSE 2 END, abs(x.kva - z.kva), x.ord)) FROM gspecs x)
""")
cte("gtx_loss", """
SELECT *, p0_kw * 720 + pk_kw * pow(s_max_kva / kva, 2) * 720 * (0.25 * 0.42 + 0.75 * 0.42 * 0.42) * 1.02 AS loss_kwh, p0_kw * 720 AS noload_kwh,
  CASE WHEN capacity_kva > 0 THEN s_max_kva / capacity_kva ELSE 0 END AS ratio FROM gtx
""")


def transformers(spark, d, place: DataFrame | None = None, customers: DataFrame | None = None) -> DataFrame:
    z = lv(spark, d, place, customers).join(transformer_sites(spark, d).select("site", "kvas", "config", "phases", "voltage_class"), "site")
    return losses.transformer_table(catalogue_nearest(z, SPECS))


@query("transformer_table", """
SELECT site, customers, round(s_max_kva, 6) AS s_max_kva, round(capacity_kva, 6) AS capacity_kva, round(loss_kwh, 4) AS loss_kwh, round(noload_kwh, 4) AS noload_kwh, round(ratio, 6) AS loading_ratio,
  CASE WHEN ratio > 1.2 THEN 'SOBRECARGADO_CRITICO' WHEN ratio >= 1 THEN 'SOBRECARGADO' WHEN ratio >= 0.8 THEN 'ALTA_CARGA' WHEN ratio >= 0.3 THEN 'ADECUADO' WHEN ratio >= 0.15 THEN 'SUBUTILIZADO' ELSE 'MUY_SUBUTILIZADO' END AS loading_class,
  round(CASE WHEN ratio < 0.3 THEN least(1, greatest(0, (0.3 - ratio) / 0.3)) ELSE 0 END, 6) AS n4
FROM gtx_loss
""")
def _(spark, d):
    t = transformers(spark, d).withColumn("n4", signals.loading_incoherence(F.col("loading_ratio")))
    cols = ["site", "customers", "s_max_kva", "capacity_kva", "loss_kwh", "noload_kwh", "loading_ratio", "loading_class", "n4"]
    return rounded(t.select(*cols), s_max_kva=6, capacity_kva=6, loss_kwh=4, noload_kwh=4, loading_ratio=6, n4=6)


@query("bank_capacities", """
WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN [p_size::DOUBLE] WHEN p_partkey % 4 = 1 THEN [p_size::DOUBLE, 20] WHEN p_partkey % 4 = 2 THEN [p_size::DOUBLE, p_size, p_size] ELSE [p_size::DOUBLE, 20, 30] END AS k FROM part),
c AS (SELECT *, CASE WHEN len(k) = 1 THEN 'UNIDAD_SIMPLE' WHEN len(k) = 2 THEN 'DELTA_ABIERTO' WHEN (list_max(k) - list_min(k)) / list_max(k) < 0.05 THEN 'BANCO_3' ELSE 'DELTA_4H' END AS config FROM b)
SELECT p_partkey, config, CASE config WHEN 'UNIDAD_SIMPLE' THEN 1.0 WHEN 'DELTA_ABIERTO' THEN 0.7 WHEN 'BANCO_3' THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence,
  round(CASE config WHEN 'UNIDAD_SIMPLE' THEN k[1] WHEN 'DELTA_ABIERTO' THEN sqrt(3) * list_min(k) WHEN 'BANCO_3' THEN 3 * list_sum(k) / len(k) ELSE list_sum(k) - 0.05 * list_max(k) END, 6) AS capacity_kva FROM c
""")
def _(spark, d):
    s, k = F.col("p_size").cast("double"), F.col("p_partkey") % 4
    kvas = F.when(k == 0, F.array(s)).when(k == 1, F.array(s, F.lit(20.0))).when(k == 2, F.array(s, s, s)).otherwise(F.array(s, F.lit(20.0), F.lit(30.0)))
    config, trust = losses.infer_bank("kvas")
    b = table(spark, d, "part").select("p_partkey", kvas.alias("kvas")).withColumns({"config": config, "confidence": trust})
    return b.select("p_partkey", "config", "confidence", F.round(losses.bank_capacity("kvas", "config"), 6).alias("capacity_kva"))


@query("meter_losses", """
SELECT feeder, round(sum(CASE k % 3 WHEN 0 THEN 0.8 WHEN 1 THEN 1.0 ELSE 1.0 END) * 720 / 1000, 4) AS meter_kwh FROM gnodes GROUP BY 1
""")
def _(spark, d):
    return rounded(losses.meter_loss_kwh(node_customers(spark, d), "feeder", 720.0), meter_kwh=4)


@query("segment_losses", """
WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity AS i, 0.3 + l_discount AS r, l_tax + 0.01 AS km, 1 + l_linenumber % 3 AS ph, l_quantity / 4 AS n FROM lineitem)
SELECT l_orderkey, round(sum((ph * i * i * r * (1 + 0.00403 * 30) * km + n * n * 0.86 * km) / 1000), 4) AS peak_kw,
  round(sum((ph * i * i * r * (1 + 0.00403 * 30) * km + n * n * 0.86 * km) / 1000) * 720 * (0.25 * 0.42 + 0.75 * 0.42 * 0.42), 3) AS loss_kwh FROM c GROUP BY 1
""")
def _(spark, d):
    i = F.col("l_quantity")
    peak = losses.segment_peak_loss_kw(
        i, electric.resistance_at(0.3 + F.col("l_discount"), 50.0, 0.00403), F.col("l_tax") + 0.01, 1 + F.col("l_linenumber") % 3, i / 4, F.lit(0.86))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(peak).alias("peak_kw"))
    g = g.withColumn("loss_kwh", F.col("peak_kw") * 720.0 * electric.loss_factor(F.lit(0.42), F.lit(0.25)))
    return rounded(g, peak_kw=4, loss_kwh=3)


@query("phase_imbalance", """
WITH p AS (SELECT l_suppkey, sum(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_linenumber % 3 = 1 THEN l_quantity ELSE 0 END) AS b, sum(CASE WHEN l_linenumber % 3 = 2 THEN l_quantity ELSE 0 END) AS c FROM lineitem GROUP BY 1),
m AS (SELECT *, (a + b + c) / 3 AS m FROM p)
SELECT l_suppkey, round(CASE WHEN m > 0 THEN greatest(abs(a - m), abs(b - m), abs(c - m)) / m * 100 ELSE 0 END, 6) AS imbalance_pct,
  round(pow(a + b + c - 3 * least(a, b, c), 2) * 0.1 * 720 * 0.2373 / 1000, 3) AS benefit_kwh FROM m
""")
def _(spark, d):
    q = lambda i: F.sum(F.when(F.col("l_linenumber") % 3 == i, F.col("l_quantity")).otherwise(0.0))
    p = table(spark, d, "lineitem").groupBy("l_suppkey").agg(q(0).alias("a"), q(1).alias("b"), q(2).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return p.select("l_suppkey", F.round(losses.phase_imbalance_pct(a, b, c), 6).alias("imbalance_pct"),
                    F.round(losses.rebalance_benefit_kwh(a, b, c, F.lit(0.1), 720.0, F.lit(0.2373)), 3).alias("benefit_kwh"))


# --- load flow -----------------------------------------------------------------

def conductor_table(spark, d) -> DataFrame:
    """Conductors known to the catalogue: the kinds that occur in the parts table."""
    kind = F.col("p_partkey") % 4
    return table(spark, d, "part").select(
        F.concat(F.lit("C"), kind.cast("string")).alias("code"), (0.2 + 0.1 * kind).alias("r_ohm_km"),
        F.lit(0.35).alias("x_ohm_km"), (0.6 + 0.4 * kind).alias("ampacity_a")).distinct()


def _flow_inputs(spark, d):
    e, t = _tree(spark, d)
    z = stage(powerflow.impedances(t, e, conductor_table(spark, d)), "z")
    return z, stage(powerflow.base_voltages(z, e, sources(spark, d)), "base")


def node_loads(spark, d) -> DataFrame:
    c = TARIFF_CLASSES["BT Residencial"]
    kw = electric.velander_kw(F.col("energy_kwh"), F.lit(c["a"]), F.lit(c["b"]))
    return node_customers(spark, d).groupBy("feeder", "node").agg(F.sum(kw).alias("kw")).withColumn("pf", F.lit(0.92))


cte("gz", """
SELECT t.feeder, t.node, t.parent, t.segment_id,
  CASE WHEN t.parent IS NULL THEN 0 ELSE coalesce(CASE WHEN e.conductor <= 'C3' THEN (0.2 + 0.1 * CAST(substr(e.conductor, 2) AS INTEGER)) * (1 + 0.00403 * 30) END, 0.01) * t.length_km END AS r,
  CASE WHEN t.parent IS NULL THEN 0 ELSE coalesce(CASE WHEN e.conductor <= 'C3' THEN 0.35 END, 0.01) * t.length_km END AS x
FROM gtree t LEFT JOIN gedges e USING (feeder, segment_id)
""")
cte("gcur", """
SELECT feeder, node, p / v0 AS i_re, -p * sqrt(1 - 0.92 * 0.92) / 0.92 / v0 AS i_im, v0 FROM (
  SELECT feeder, node, (0.0002 * kwh + 0.03 * sqrt(kwh)) * 1000 / 3 AS p, 13800 / sqrt(3) AS v0 FROM gload)
""")
cte("gbr", "SELECT c.feeder, c.anc AS node, sum(i_re) AS i_re, sum(i_im) AS i_im FROM rec_closure c JOIN gcur i ON i.node = c.node GROUP BY 1, 2")


@query("load_flow_first_sweep", """
SELECT c.feeder, c.node, round(13800 / sqrt(3) - sum(b.i_re * z.r - b.i_im * z.x), 5) AS v_re, round(-sum(b.i_re * z.x + b.i_im * z.r), 5) AS v_im
FROM rec_closure c JOIN gbr b ON b.feeder = c.feeder AND b.node = c.anc JOIN gz z ON z.feeder = c.feeder AND z.node = c.anc GROUP BY 1, 2
""")
def _(spark, d):
    z, base = _flow_inputs(spark, d)
    f = powerflow.balanced_flow(z, node_loads(spark, d), base, max_sweeps=1)
    return rounded(f.select("feeder", "node", "v_re", "v_im"), v_re=5, v_im=5)


def flow_ctes(tag: str, loads: str, phases: list[tuple[str, str, str]], mutual: float, closure: str = "rec_closure", sweeps: int = 10) -> None:
    """The sweeps written out as fragments, the result in ``<tag>_flow``: each a sum over the closure below and one above.

    ``loads``: feeder, home (the feeder whose network it has), node, k, w (watts). ``closure``: feeder, node, anc. ``phases``:
    name, watts, angle. A feeder's result is that of its first sweep that changes no voltage by more than a millionth.
    """
    names = [n for n, _, _ in phases]
    keep = lambda name, body: cte(f"{tag}_{name}", body, kept=True)
    keep("clo", f"SELECT feeder, node, anc FROM {closure}")
    keep("z", f"""
SELECT l.feeder, g.node, g.parent, g.segment_id, g.r, g.x, t.length_km, e.n_phases, 13800 / sqrt(3) AS v0, {", ".join(f"{w} AS p_{n}" for n, w, _ in phases)}
FROM {loads} l JOIN gz g ON g.feeder = l.home AND g.node = l.node JOIN gtree t ON t.feeder = g.feeder AND t.node = g.node LEFT JOIN gedges e ON e.feeder = g.feeder AND e.segment_id = g.segment_id
""")
    keep("s0", f"SELECT feeder, node, {', '.join(f'v0 * cos({a}) AS vr_{n}, v0 * sin({a}) AS vi_{n}' for n, _, a in phases)} FROM {tag}_z")
    tan = "sqrt(1 - 0.92 * 0.92) / 0.92"
    for k in range(1, sweeps + 1):
        i = ", ".join(
            f"CASE WHEN p_{n} <> 0 THEN (p_{n} * vr_{n} + p_{n} * {tan} * vi_{n}) / (vr_{n} * vr_{n} + vi_{n} * vi_{n}) ELSE 0 END AS ir_{n}, "
            f"CASE WHEN p_{n} <> 0 THEN (p_{n} * vi_{n} - p_{n} * {tan} * vr_{n}) / (vr_{n} * vr_{n} + vi_{n} * vi_{n}) ELSE 0 END AS ii_{n}" for n in names)
        sums = ", ".join(f"sum(ir_{n}) AS ir_{n}, sum(ii_{n}) AS ii_{n}" for n in names)
        other = {n: [o for o in names if o != n] for n in names}
        drop = ", ".join(
            f"ir_{n} * r - ii_{n} * x - {mutual} * x * ({' + '.join(f'ii_{o}' for o in other[n]) or '0'}) AS dr_{n}, "
            f"ir_{n} * x + ii_{n} * r + {mutual} * x * ({' + '.join(f'ir_{o}' for o in other[n]) or '0'}) AS di_{n}" for n in names)
        new = ", ".join(f"any_value(v0) * cos({a}) - sum(dr_{n}) AS vr_{n}, any_value(v0) * sin({a}) - sum(di_{n}) AS vi_{n}" for n, _, a in phases)
        change = ", ".join(f"sqrt(pow(n.vr_{x} - o.vr_{x}, 2) + pow(n.vi_{x} - o.vi_{x}, 2))" for x in names)
        keep(f"b{k}", f"SELECT c.feeder, c.anc AS node, {sums} FROM {tag}_clo c JOIN (SELECT feeder, node, {i} FROM {tag}_z JOIN {tag}_s{k - 1} USING (feeder, node)) i USING (feeder, node) GROUP BY 1, 2")
        keep(f"d{k}", f"SELECT feeder, node, v0, {drop} FROM {tag}_b{k} JOIN {tag}_z USING (feeder, node)")
        keep(f"s{k}", f"SELECT c.feeder, c.node, {new} FROM {tag}_clo c JOIN {tag}_d{k} d ON d.feeder = c.feeder AND d.node = c.anc GROUP BY 1, 2")
        keep(f"w{k}", f"SELECT feeder, max(greatest({change}) / v0) AS worst FROM {tag}_s{k} n JOIN {tag}_s{k - 1} o USING (feeder, node) JOIN {tag}_z USING (feeder, node) GROUP BY 1")
    through = " UNION ALL ".join(f"SELECT feeder, {k} AS k, worst FROM {tag}_w{k}" for k in range(1, sweeps + 1))
    keep("stop", f"SELECT feeder, min(k) AS iterations FROM ({through}) WHERE worst < 1e-6 GROUP BY 1")
    rows = " UNION ALL ".join(f"SELECT * FROM {tag}_b{k} JOIN {tag}_s{k} USING (feeder, node) JOIN {tag}_stop USING (feeder) WHERE iterations = {k}" for k in range(1, sweeps + 1))
    keep("flow", f"SELECT * FROM ({rows}) JOIN {tag}_z USING (feeder, node)")


_THIRD = "2 * pi() / 3"
THREE_PHASES = [
    ("a", "CASE WHEN k % 8 NOT IN (2, 3) THEN w ELSE 0 END", "0.0"), ("b", "CASE WHEN k % 8 = 2 THEN w ELSE 0 END", f"-{_THIRD}"),
    ("c", "CASE WHEN k % 8 = 3 THEN w ELSE 0 END", _THIRD)]


def flow3_ctes(tag: str, loads: str, closure: str = "rec_closure") -> None:
    """The three-phase flow and, in ``<tag>_sum``, its summary per feeder."""
    flow_ctes(tag, loads, THREE_PHASES, 0.4, closure)
    cte(f"{tag}_mag", f"""
SELECT *, sqrt(ir_a * ir_a + ii_a * ii_a) AS ma, sqrt(ir_b * ir_b + ii_b * ii_b) AS mb, sqrt(ir_c * ir_c + ii_c * ii_c) AS mc,
  least(sqrt(vr_a * vr_a + vi_a * vi_a), sqrt(vr_b * vr_b + vi_b * vi_b), sqrt(vr_c * vr_c + vi_c * vi_c)) / v0 AS v FROM {tag}_flow
""")
    cte(f"{tag}_sum", f"""
SELECT feeder, sum(CASE WHEN segment_id IS NOT NULL THEN (ma * ma + mb * mb + mc * mc) * r ELSE 0 END) / 1000 AS phases,
  sum(CASE WHEN segment_id IS NOT NULL THEN (pow(ir_a + ir_b + ir_c, 2) + pow(ii_a + ii_b + ii_c, 2)) * length_km * 0.86 ELSE 0 END) / 1000 AS neutral, min(v) AS v,
  coalesce(max(CASE WHEN mean > 0 AND mean >= 0.1 * top THEN greatest(abs(ma - mean), abs(mb - mean), abs(mc - mean)) / mean * 100 END), 0) AS imbalance, max(iterations) AS iterations
FROM (SELECT *, max(mean) OVER (PARTITION BY feeder) AS top FROM (SELECT *, CASE WHEN segment_id IS NOT NULL AND n_phases = 3 THEN (ma + mb + mc) / 3 END AS mean FROM {tag}_mag))
GROUP BY 1
""")


cte("gwatts", "SELECT feeder, feeder AS home, node, k, kwh, (0.0002 * kwh + 0.03 * sqrt(kwh)) * 1000 AS w FROM gload")
flow_ctes("flowone", "gwatts", [("a", "w / 3", "0.0")], 0.0)
flow3_ctes("flowthree", "gwatts")


def balanced(spark, d) -> DataFrame:
    z, base = _flow_inputs(spark, d)
    return powerflow.balanced_flow(z, node_loads(spark, d), base)


@query("load_flow_balanced", """
SELECT feeder, round(sum(3 * (ir_a * ir_a + ii_a * ii_a) * r) / 1000, 5) AS loss_kw_peak, round(min(sqrt(vr_a * vr_a + vi_a * vi_a) / v0), 7) AS v_min_pu,
  round(max(sqrt(ir_a * ir_a + ii_a * ii_a)) FILTER (segment_id IS NOT NULL), 5) AS i_max_a, true AS converged, CAST(max(iterations) AS INTEGER) AS iterations
FROM flowone_flow GROUP BY 1
""")
def _(spark, d):
    return rounded(powerflow.flow_summary(balanced(spark, d)), loss_kw_peak=5, v_min_pu=7, i_max_a=5)


def unbalanced(spark, d) -> DataFrame:
    z, base = _flow_inputs(spark, d)
    c = TARIFF_CLASSES["BT Residencial"]
    kw = electric.velander_kw(F.col("energy_kwh"), F.lit(c["a"]), F.lit(c["b"]))
    return powerflow.unbalanced_flow(z, powerflow.loads_by_phase(node_customers(spark, d), kw), base)


@query("load_flow_unbalanced", """
SELECT feeder, round(phases, 5) AS loss_phases_kw, round(neutral, 5) AS loss_neutral_kw, round(v, 7) AS v_min_pu, round(imbalance, 5) AS imbalance_pct_max, true AS converged,
  CAST(iterations AS INTEGER) AS iterations, round(phases + neutral, 5) AS loss_kw_peak FROM flowthree_sum
""")
def _(spark, d):
    return rounded(powerflow.unbalanced_summary(unbalanced(spark, d)), loss_phases_kw=5, loss_neutral_kw=5, v_min_pu=7, imbalance_pct_max=5, loss_kw_peak=5)


@query("load_flow_residuals", """
SELECT feeder, count(*) FILTER (depth > 0) AS segments, true AS drops_hold, true AS currents_hold, true AS power_holds FROM gtree GROUP BY 1
""")
def _(spark, d):
    return powerflow.flow_residuals(balanced(spark, d)).select(
        "feeder", "segments", (F.col("drop_pu") < 1e-6).alias("drops_hold"), (F.col("current_pu") < 1e-5).alias("currents_hold"),
        (F.col("power_pu") < 1e-5).alias("power_holds"))


@query("load_by_phase", """
SELECT feeder, node, round(CASE WHEN k % 8 NOT IN (2, 3) THEN w ELSE 0 END, 6) AS kw_a, round(CASE WHEN k % 8 = 2 THEN w ELSE 0 END, 6) AS kw_b, round(CASE WHEN k % 8 = 3 THEN w ELSE 0 END, 6) AS kw_c
FROM (SELECT *, 0.0002 * kwh + 0.03 * sqrt(kwh) AS w FROM gload)
""")
def _(spark, d):
    kw = electric.velander_kw(F.col("energy_kwh"), F.lit(0.0002), F.lit(0.03))
    return rounded(powerflow.loads_by_phase(node_customers(spark, d), kw), kw_a=6, kw_b=6, kw_c=6)


# --- assembly, versions, quality -------------------------------------------------

cte("head_meters", "SELECT 'G' || lpad(CAST(o_custkey % 20 AS VARCHAR), 2, '0') AS feeder, sum(floor(l_extendedprice)) / 8000 AS input_kwh FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 20 % 7 <> 0 GROUP BY 1")


def head_meters(spark, d) -> DataFrame:
    """Energy that the heads measured, from ``lineitem``; every seventh feeder has no meter."""
    g = F.col("o_custkey") % FEEDERS
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    home = table(spark, d, "orders").where(g % 7 != 0).select("o_orderkey", code("G", g, 2).alias("feeder"))
    return lines.join(home, "o_orderkey").groupBy("feeder").agg((F.sum(F.floor("l_extendedprice")) / 8000.0).alias("input_kwh"))


def grid_plan(spark, d) -> GridPlan:
    return analyse_grid(
        edges(spark, d), sources(spark, d), conductor_table(spark, d), transformer_sites(spark, d), stage(node_customers(spark, d), "customers"),
        stage(lamps(spark, d), "lamps"), SPECS, head_meters(spark, d))


FACTOR = "(0.25 * 0.42 + 0.75 * 0.42 * 0.42)"
cte("gcomp", f"""
SELECT f.feeder, f.v, f.neutral * 720 * {FACTOR} AS neutral_kwh, (f.phases + f.neutral) * 720 * {FACTOR} AS conductors_kwh, coalesce(t.loss, 0) AS transformers_kwh, coalesce(t.idle, 0) AS noload_kwh, m.w * 720 / 1000 AS meters_kwh,
  coalesce(z.billed, 0) + coalesce(o.billed, 0) AS billed_kwh, coalesce(z.light, 0) AS lighting_kwh, m.n
FROM flowthree_sum f LEFT JOIN (SELECT feeder, sum(loss_kwh) AS loss, sum(noload_kwh) AS idle FROM gtx_loss GROUP BY 1) t USING (feeder)
LEFT JOIN (SELECT feeder, sum(billed_kwh) AS billed, sum(lighting_kwh) AS light FROM gzone_lv GROUP BY 1) z USING (feeder)
LEFT JOIN (SELECT g.feeder, sum(g.kwh) AS billed FROM gload g LEFT JOIN gplaced p ON p.feeder = g.feeder AND p.node = g.node WHERE p.site IS NULL AND k % 40 <> 20 GROUP BY 1) o USING (feeder)
LEFT JOIN (SELECT feeder, sum(CASE k % 3 WHEN 0 THEN 0.8 ELSE 1.0 END) AS w, count(*) AS n FROM gnodes GROUP BY 1) m USING (feeder)
""")
cte("gbalance", """
SELECT *, CASE WHEN i > 0 THEN ntl / i * 100 ELSE 0 END AS ntl_pct, CASE WHEN i > 0 THEN technical / i * 100 ELSE 0 END AS technical_pct FROM (
  SELECT *, i - billed_kwh - lighting_kwh - billed_kwh * 0.001 - technical AS ntl FROM (
    SELECT c.*, conductors_kwh + transformers_kwh + meters_kwh AS technical, coalesce(h.input_kwh, billed_kwh + lighting_kwh + billed_kwh * 0.001) AS i, h.input_kwh IS NULL AS unmeasured
    FROM gcomp c LEFT JOIN head_meters h USING (feeder)))
""")


@query("grid_balance", """
SELECT feeder, round(billed_kwh, 3) AS billed_kwh, round(lighting_kwh, 3) AS lighting_kwh, round(i, 3) AS input_kwh, round(technical, 3) AS technical_kwh, round(ntl, 3) AS ntl_kwh, round(ntl_pct, 4) AS ntl_pct,
  CASE WHEN unmeasured THEN 'INDICATIVO' ELSE 'MEDIDO' END AS balance_type, round(v, 6) AS v_min_pu, n AS customers,
  array_to_string(list_filter([CASE WHEN ntl < 0 THEN 'C01' END, CASE WHEN ntl_pct > 60 THEN 'C02' END, CASE WHEN billed_kwh > i THEN 'C03' END, CASE WHEN technical_pct > 20 THEN 'C04' END], lambda x: x IS NOT NULL), ',') AS triggered
FROM gbalance
""")
def _(spark, d):
    b = grid_plan(spark, d).balance
    fired = F.array_join(F.transform(F.filter("controls", lambda x: x["triggered"]), lambda x: x["code"]), ",")
    rows = b.select("feeder", "billed_kwh", "lighting_kwh", "input_kwh", "technical_kwh", "ntl_kwh", "ntl_pct", "balance_type", "v_min_pu",
                    F.col("customers_traced").alias("customers"), fired.alias("triggered"))
    return rounded(rows, billed_kwh=3, lighting_kwh=3, input_kwh=3, technical_kwh=3, ntl_kwh=3, ntl_pct=4, v_min_pu=6)


@query("grid_components", """
SELECT feeder, component, round(kwh, 4) AS kwh FROM (UNPIVOT (
  SELECT feeder, conductors_kwh AS RED_CONDUCTORES, transformers_kwh AS TRANSF_DIST_TOTAL, noload_kwh AS TRANSF_DIST_VACIO, meters_kwh AS MEDIDORES, neutral_kwh AS NEUTRO FROM gcomp)
  ON RED_CONDUCTORES, TRANSF_DIST_TOTAL, TRANSF_DIST_VACIO, MEDIDORES, NEUTRO INTO NAME component VALUE kwh) WHERE component <> 'NEUTRO' OR kwh > 0
""")
def _(spark, d):
    return rounded(grid_plan(spark, d).component_rows(), kwh=4)


def _normal_sql(factor: str, seed: int) -> str:
    u = lambda tag: f"((CAST('0x' || substr(md5(feeder || '|' || draw || '|{factor}|{tag}|{seed}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)"
    return f"sqrt(-2 * ln({u('r')})) * cos(2 * pi() * {u('t')})"


def _factor_sql(factor: str, pct: float) -> str:
    return f"greatest(1 + {pct} / 100.0 * {_normal_sql(factor, 20260807)}, 0.05)"


_BANDS_SQL = "feeder, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90, avg(v) AS mean, stddev_pop(v) AS std, count(*) AS samples"
cte("gbands", f"""
SELECT {_BANDS_SQL} FROM (
  SELECT feeder, conductors_kwh * {_factor_sql('conductor', 10.0)} * {_factor_sql('length', 5.0)} + greatest(transformers_kwh - noload_kwh, 0) * {_factor_sql('load_p', 15.0)} * {_factor_sql('load_f', 20.0)}
    + noload_kwh * {_factor_sql('noload_p', 15.0)} + meters_kwh AS v FROM gcomp, (SELECT unnest(range(1, 201)) AS draw)) GROUP BY 1
""", kept=True)
_ROUNDED_BANDS = "SELECT feeder, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("p10", "p50", "p90", "mean", "std")) + ", samples FROM "
_BAND_DIGITS = dict(p10=4, p50=4, p90=4, mean=4, std=4)


@query("montecarlo_losses", _ROUNDED_BANDS + "gbands")
def _(spark, d):
    return rounded(grid_plan(spark, d).bands()[0], **_BAND_DIGITS)


@query("montecarlo_ntl", _ROUNDED_BANDS + f"""(SELECT {_BANDS_SQL} FROM (
  SELECT feeder, i - billed_kwh - lighting_kwh - billed_kwh * 0.001 - greatest(mean + greatest(std, 1e-9) * {_normal_sql('ntl', 20260808)}, 0) AS v
  FROM gbalance JOIN gbands USING (feeder), (SELECT unnest(range(1, 201)) AS draw)) GROUP BY 1)""")
def _(spark, d):
    return rounded(grid_plan(spark, d).bands()[1], **_BAND_DIGITS)


@query("element_counts", """
SELECT feeder, count(*) AS n, 'segments' AS kind FROM gedges GROUP BY 1 UNION ALL SELECT feeder, count(*), 'sites' FROM gsites GROUP BY 1
UNION ALL SELECT feeder, count(*), 'customers' FROM gnodes GROUP BY 1 UNION ALL SELECT feeder, count(*), 'lights' FROM glamps GROUP BY 1
""")
def _(spark, d):
    return network.element_counts(segments=edges(spark, d), sites=transformer_sites(spark, d), customers=grid_nodes(spark, d), lights=lamps(spark, d))


def _hashes(spark, d, changed: bool):
    e, s, w = edges(spark, d), transformer_sites(spark, d), switches(spark, d)
    g = F.substring("feeder", 2, 2).cast("int")
    if changed:
        e = e.withColumn("length_km", F.when(g % 5 == 1, F.col("length_km") + 0.5).otherwise(F.col("length_km")))
        e = e.withColumn("conductor", F.when(g % 5 == 2, F.lit("C9")).otherwise(F.col("conductor")))
        w = w.withColumn("current_pos", F.when(g % 5 == 2, F.lit("X")).otherwise(F.col("current_pos")))
    return network.feeder_hashes(e, s, w, sources(spark, d))


@query("version_registration", """
SELECT feeder, CASE WHEN g = 19 THEN 'ALTA' WHEN g % 5 IN (1, 2) THEN 'ACTUALIZACION' ELSE 'SIN_CAMBIO' END AS action,
  CASE WHEN g = 19 THEN 1 WHEN g % 5 IN (1, 2) THEN 4 ELSE 3 END AS version, CASE WHEN g = 19 THEN '' WHEN g % 5 = 1 THEN 'topology' WHEN g % 5 = 2 THEN 'attribute,switch' ELSE '' END AS changed,
  CASE WHEN g = 19 THEN 'balance,calidad,flujo,focalizacion,perdidas,topologia,topologia_dinamica' WHEN g % 5 = 1 THEN 'balance,flujo,focalizacion,perdidas,topologia'
    WHEN g % 5 = 2 THEN 'balance,calidad,flujo,perdidas,topologia_dinamica' ELSE '' END AS stages
FROM (SELECT DISTINCT feeder, g FROM gnodes)
""")
def _(spark, d):
    old = _hashes(spark, d, False).where(F.col("feeder") != "G19").withColumn("version", F.lit(3))
    out = network.register_versions(old, _hashes(spark, d, True))
    return out.select("feeder", "action", "version", F.array_join("changed", ",").alias("changed"), F.array_join("stages", ",").alias("stages"))


cte("gfind", """
SELECT feeder, 'R12' AS rule, 'CRITICA' AS severity, segment_id AS element FROM gedges WHERE conductor IS NULL
UNION ALL SELECT feeder, 'R05', 'CRITICA', segment_id FROM gedges WHERE conductor = 'C4'
UNION ALL SELECT feeder, 'R11', 'ALTA', segment_id FROM gedges WHERE conductor IS NOT NULL AND (length_km <= 0 OR length_km > 5)
UNION ALL SELECT feeder, 'R22', 'CRITICA', node FROM (SELECT feeder, from_node AS node FROM gedges UNION SELECT feeder, to_node FROM gedges EXCEPT SELECT feeder, node FROM gtree)
UNION ALL SELECT feeder, unnest(['R24', 'P01']), 'CRITICA', site FROM gsites WHERE len(kvas) = 0
UNION ALL SELECT feeder, 'P09', 'ALTA', site FROM (SELECT *, CASE WHEN config = 'BANCO_3' THEN 3 * list_sum(kvas) / len(kvas) ELSE kvas[1] END AS cap FROM gsites WHERE len(kvas) > 0) WHERE abs(kva - cap) / cap > 0.1
UNION ALL SELECT p.feeder, 'R15', 'ALTA', CAST(g.k AS VARCHAR) FROM gplaced p JOIN gnodes g ON g.node = p.node WHERE p.site IS NOT NULL AND p.site <> 'T' || lpad(CAST(g.k // 4 * 4 AS VARCHAR), 7, '0')
UNION ALL SELECT e.feeder, 'R09', 'ALTA', e.segment_id FROM gedges e JOIN flowone_flow f ON f.feeder = e.feeder AND f.segment_id = e.segment_id
  WHERE e.conductor <= 'C3' AND sqrt(f.ir_a * f.ir_a + f.ii_a * f.ii_a) > 0.6 + 0.4 * CAST(substr(e.conductor, 2) AS INTEGER)
""")


def findings(spark, d) -> DataFrame:
    e, t, lv_ = walk(spark, d)
    sites = transformer_sites(spark, d)
    sized = sites.withColumns({"capacity_kva": losses.bank_capacity("kvas", "config"), "units": F.size("kvas")})
    placed = network.assign_to_sites(t, lv_, sites).join(grid_nodes(spark, d).select("feeder", "node", F.col("k").alias("account")), ["feeder", "node"])
    declared = grid_nodes(spark, d).select(F.col("k").alias("account"), code("T", F.floor(F.col("k") / 4) * 4, 7).alias("site"))
    z = stage(powerflow.impedances(t, e, conductor_table(spark, d)), "z")
    flow = powerflow.balanced_flow(z, node_loads(spark, d), stage(powerflow.base_voltages(z, e, sources(spark, d)), "base"))
    currents = powerflow.branch_currents(flow)
    return network.quality_findings(e, conductor_table(spark, d), network.islands(e, t), sized, currents=currents, declared=declared, traced=placed)


@query("quality_findings", "SELECT * FROM gfind")
def _(spark, d):
    return findings(spark, d).select("feeder", "rule", "severity", "element")


@query("quality_summary", "SELECT rule, severity, count(*) AS findings FROM gfind GROUP BY 1, 2")
def _(spark, d):
    return network.findings_summary(findings(spark, d))


@query("network_integrity", """
SELECT 'CLIENTE_SIN_CONEXION' AS "check", CAST(c_custkey AS VARCHAR) AS element FROM customer WHERE c_custkey % 50 = 0
UNION ALL SELECT 'UNIDAD_SIN_PUESTO', CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > -900)
UNION ALL SELECT 'LINEA_SIN_VERTICES', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size % 9 < 2
""")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.when(F.col("c_custkey") % 50 == 0, " ").otherwise("x").alias("connection"))
    u = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("unit"), F.col("l_suppkey").alias("site"))
    s = table(spark, d, "supplier").where(F.col("s_acctbal") > -900).select(F.col("s_suppkey").alias("site"))
    l = table(spark, d, "part").select(F.col("p_partkey").alias("segment_id"), (F.col("p_size") % 9).alias("vertices"))
    return network.integrity(c, u, s, l)


@query("delete_dependants", """
SELECT l_suppkey AS element, count(*) AS dependants, 'lineitem' AS layer FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1
""")
def _(spark, d):
    t = table(spark, d, "supplier").where(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("element"))
    return network.dependants(t, {"lineitem": table(spark, d, "lineitem").select(F.col("l_suppkey").alias("element"))})


@query("feeder_restriction", """
SELECT account FROM (SELECT k AS account, node FROM gnodes) WHERE node IN (SELECT from_node FROM gedges WHERE feeder IN ('G01', 'G05') UNION SELECT to_node FROM gedges WHERE feeder IN ('G01', 'G05'))
""")
def _(spark, d):
    wanted = network.nodes_of(edges(spark, d).where(F.col("feeder").isin("G01", "G05")))
    return network.restrict_to_feeders(grid_nodes(spark, d), wanted).select(F.col("k").alias("account"))


@query("ordered_binding", """
SELECT a.account, s.feeder, s.node FROM (SELECT c_custkey AS account, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer) a
JOIN (SELECT feeder, node, row_number() OVER (ORDER BY feeder, node) AS pos FROM gnodes) s USING (pos)
""")
def _(spark, d):
    return network.bind_in_order(table(spark, d, "customer").select(F.col("c_custkey").alias("account")), grid_nodes(spark, d))


@query("zone_residuals", """
WITH z AS (SELECT zone, sum(kwh) AS billed FROM gzones z JOIN gload g ON g.node = z.node GROUP BY 1)
SELECT zone, billed AS billed_kwh, round(billed * 0.04, 4) AS residual_kwh, round(CASE WHEN billed > 0 THEN billed * 0.04 / (billed * 1.08) ELSE 0 END, 6) AS n1 FROM z
""")
def _(spark, d):
    _, t, lv_ = walk(spark, d)
    z = network.protection_zones(t, lv_, switches(spark, d))
    g = z.join(node_customers(spark, d), ["feeder", "node"]).groupBy("zone").agg(F.sum("energy_kwh").alias("billed_kwh"))
    # Without metering at the zone the input is estimated from the billed energy.
    r, s = signals.zone_residual(F.col("billed_kwh") * 1.08, F.col("billed_kwh"), F.col("billed_kwh") * 0.04)
    return g.select("zone", "billed_kwh", F.round(r, 4).alias("residual_kwh"), F.round(s, 6).alias("n1"))


# --- raw tables ------------------------------------------------------------------

@query("network_tables", """
SELECT 'S' || p_partkey AS segment_id, CASE WHEN p_partkey % 6 = 0 THEN 0.0::DOUBLE ELSE p_size / 10.0::DOUBLE END AS length_km, CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE CAST(1 + p_partkey % 3 AS INTEGER) END AS n_phases, 13800.0::DOUBLE AS voltage_v, false AS is_lv FROM part
""")
def _(spark, d):
    k = F.col("p_partkey")
    raw = table(spark, d, "part").select(
        F.concat(F.lit("S"), k.cast("string")).alias("segment_id"), F.when(k % 6 != 0, F.col("p_size") / 10.0).alias("length_km"),
        F.when(k % 5 == 0, F.lit(0)).otherwise(1 + k % 3).alias("n_phases"))
    return network_tables.segments(raw).select("segment_id", "length_km", "n_phases", "voltage_v", "is_lv")


@query("site_tables", """
SELECT 'T' || p_partkey AS site, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN 15 WHEN 2 THEN p_size END AS kva,
  CASE p_partkey % 4 WHEN 0 THEN [10.0::DOUBLE, 20] WHEN 1 THEN [15.0::DOUBLE] WHEN 2 THEN [p_size::DOUBLE] ELSE [] END AS kvas, 'UNIDAD_SIMPLE' AS config FROM part
""")
def _(spark, d):
    k = F.col("p_partkey") % 4
    raw = table(spark, d, "part").select(
        F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("site"), F.when(k.isin(0, 2), F.col("p_size").cast("double")).alias("kva"),
        F.when(k == 0, "[10, 20]").when(k == 1, "15KVA").alias("kvas"))
    return network_tables.sites(raw).select("site", "kva", "kvas", "config")


@query("nested_network", """
SELECT feeder, node, 1 AS part, lamp_w FROM glamps UNION ALL SELECT feeder, node, 2, lamp_w / 2 FROM glamps
""")
def _(spark, d):
    """Two lamps nested in each row, flattened to one row per lamp."""
    l = lamps(spark, d).select("feeder", F.array(
        F.struct("node", F.lit(1).alias("part"), "lamp_w"), F.struct("node", F.lit(2).alias("part"), (F.col("lamp_w") / 2).alias("lamp_w"))).alias("lights"))
    return network_tables.flatten(l, "lights")
