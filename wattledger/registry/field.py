"""Targets, work orders, scope, journal and scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.operators import balance, fieldwork, journal, network, rangejoin, scenarios, scoring, survey, transfers
from wattledger.registry.core import cte, query
from wattledger.registry.customers import averaged, ranking, rounded
from wattledger.registry.energy import balances, residuals, rolled
from wattledger.plans.scenario import evaluate_scenarios
from wattledger.registry.grid import (
    FACTOR, SPECS, conductor_table, edges, flow3_ctes, grid_nodes, head_meters, lamps, node_customers, sources, transformer_sites, walk)
from wattledger.registry.inputs import code, customer_series, hierarchy, register, table
from wattledger.staging import stage

_OUT = "SELECT level, entity, round(priority, 6) AS priority, round(suspicion, 6) AS suspicion, round(kwh, 3) AS kwh, customers, data_problem FROM {}"
PRIO = "least(1, greatest(0, (0.55 * {s} + 0.45 * {e}) * {f}))"


def _norm(c: str, src: str) -> str:
    return (f"(CASE WHEN (SELECT max({c}) - min({c}) FROM {src}) < 1e-12 THEN CASE WHEN {c} > 0 THEN 1 ELSE 0 END "
            f"ELSE ({c} - (SELECT min({c}) FROM {src})) / nullif((SELECT max({c}) - min({c}) FROM {src}), 0) END)")


def out(df: DataFrame) -> DataFrame:
    return rounded(df.select("level", "entity", "priority", "suspicion", "kwh", "customers", "data_problem"), priority=6, suspicion=6, kwh=3)


# --- targets -----------------------------------------------------------------

cte("t_feeder", f"""
SELECT 'ALIMENTADOR' AS level, feeder AS entity, feeder, {PRIO.format(s='s', e='e', f='greatest(0.2, least(1, conf / 100))')} AS priority, s AS suspicion, ntl_kwh AS kwh, 0::BIGINT AS customers, conf < 50 AS data_problem
FROM (SELECT *, {_norm('ntl_pct', 'feeder_balance')} AS s, {_norm('ntl_kwh', 'feeder_balance')} AS e, CAST(CAST(substr(feeder, 2) AS INTEGER) * 5 AS DOUBLE) AS conf FROM feeder_balance)
""")


def feeder_t(spark, d, b=None):
    b = (b or balances(spark, d)).withColumn("confidence", (F.substring("feeder", 2, 9).cast("int") * 5).cast("double"))
    return survey.feeder_targets(b)


@query("target_feeders", _OUT.format("t_feeder"))
def _(spark, d):
    return out(feeder_t(spark, d))


cte("zone_stat", """
SELECT z.feeder, zone, count(*) AS customers, round(sum(kwh) * 0.04, 1) AS residual_kwh, round(0.04 / 1.08, 6) AS signal FROM gzones z JOIN gload g ON g.node = z.node GROUP BY 1, 2 HAVING sum(kwh) > 0
""")


cte("t_zone", f"""
SELECT 'ZONA_PROTECCION' AS level, feeder || '/' || zone AS entity, feeder, {PRIO.format(s='signal', e=_norm('residual_kwh', 'zone_stat'), f='0.5')} AS priority, signal AS suspicion, residual_kwh AS kwh, customers, false AS data_problem FROM zone_stat
""")


def zone_t(spark, d, net=None, c=None) -> DataFrame:
    _, t, lv = net or walk(spark, d)
    from wattledger.registry.grid import switches

    z = network.protection_zones(t, lv, switches(spark, d))
    g = z.join(c or node_customers(spark, d), ["feeder", "node"]).groupBy("feeder", "zone").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("energy_kwh").alias("b")).where(F.col("b") > 0)
    # Estimated input, so the confidence is below 100.
    return survey.zone_targets(g.select(
        "feeder", "zone", "customers", F.round(F.col("b") * 0.04, 1).alias("residual_kwh"), F.lit(round(0.04 / 1.08, 6)).alias("signal"), F.lit(50.0).alias("confidence")))


@query("target_zones", _OUT.format("t_zone"))
def _(spark, d):
    return out(zone_t(spark, d))


def node_facts(spark, d, c=None) -> DataFrame:
    """Customers on nodes with a suspicion flag and recoverable energy."""
    return (c or node_customers(spark, d)).select(
        "feeder", "node", "account", "energy_kwh", ((F.col("account") % 13 == 0) & (F.col("energy_kwh") > 10)).alias("suspect"),
        F.when(F.col("account") % 13 == 0, F.col("energy_kwh") * 0.5).otherwise(0.0).alias("rec"))


cte("branch_stat", """
SELECT b.feeder, branch, count(*) AS customers, count(*) FILTER (WHERE k % 13 = 0 AND kwh > 10) AS suspects, sum(CASE WHEN k % 13 = 0 THEN kwh * 0.5 ELSE 0 END) AS rec
FROM gbranches b JOIN gload g ON g.node = b.node GROUP BY 1, 2 HAVING count(*) >= 3
""")


cte("t_branch", f"""
SELECT 'RAMAL' AS level, feeder || '/' || branch AS entity, feeder, (0.55 * s + 0.45 * {_norm('rec', 'branch_stat')}) * CASE WHEN s > 0 THEN 1 ELSE 0.15 END AS priority, s AS suspicion, rec AS kwh, customers, false AS data_problem
FROM (SELECT *, 0.5 * least(1, suspects / customers) + 0.5 * {_norm('suspects', 'branch_stat')} AS s FROM branch_stat)
""")


def branch_t(spark, d, net=None, c=None) -> DataFrame:
    _, t, lv = net or walk(spark, d)
    return survey.branch_targets(network.branches(t, lv).join(node_facts(spark, d, c), ["feeder", "node"]).groupBy("feeder", "branch").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if("suspect").alias("suspects"), F.sum("rec").alias("recoverable_kwh")))


@query("target_branches", _OUT.format("t_branch"))
def _(spark, d):
    return out(branch_t(spark, d))


cte("site_stat", """
SELECT s.feeder, s.site, s.customers, coalesce(x.suspects, 0) AS suspects, coalesce(x.rec, 0) AS rec, s.totaliser_residual_kwh AS res, s.ratio
FROM gtx_loss s LEFT JOIN (SELECT p.feeder, p.site, count(*) FILTER (WHERE k % 13 = 0 AND kwh > 10) AS suspects, sum(CASE WHEN k % 13 = 0 THEN kwh * 0.5 ELSE 0 END) AS rec FROM gplaced p JOIN gload g ON g.node = p.node GROUP BY 1, 2) x USING (feeder, site)
""")


cte("t_site", f"""
SELECT 'PUESTO_TRANSFORMACION' AS level, feeder || '/' || site AS entity, feeder, least(1, 0.55 * s + 0.45 * {_norm('rec', 'site_stat')}) AS priority, s AS suspicion, rec AS kwh, greatest(customers, 1) AS customers, false AS data_problem
FROM (SELECT *, least(1, greatest(0, 0.45 * least(1, suspects / greatest(customers, 1)) + 0.35 * {_norm('res', 'site_stat')} + 0.2 * least(1, greatest(0, (0.3 - ratio) / 0.3)))) AS s FROM site_stat)
""")


def site_t(spark, d, net=None, c=None) -> DataFrame:
    from wattledger.registry.grid import transformers

    _, t, lv = net or walk(spark, d)
    place = network.assign_to_sites(t, lv, transformer_sites(spark, d))
    f = place.join(node_facts(spark, d, c), ["feeder", "node"]).groupBy("feeder", "site").agg(
        F.count_if("suspect").alias("suspects"), F.sum("rec").alias("recoverable_kwh"))
    tx = transformers(spark, d, place, c).select("feeder", "site", "customers", F.col("totaliser_residual_kwh").cast("double").alias("totaliser_residual_kwh"), "loading_ratio")
    return survey.site_targets(tx.join(f, ["feeder", "site"], "left").fillna(0))


@query("target_sites", _OUT.format("t_site"))
def _(spark, d):
    return out(site_t(spark, d))


cte("route_raw", """
SELECT route, count(*) AS customers, count(*) FILTER (WHERE mean_low) AS suspects, sum(kwh) AS energy_kwh, sum(CASE WHEN mean_low THEN 100.0::DOUBLE ELSE 0 END) AS rec, avg(zs) * 100 AS zero_pct, avg(est) * 100 AS est_pct, avg(kwh) AS m, stddev_samp(kwh) AS sd,
  count(*) FILTER (WHERE unlinked) AS unlinked, (SELECT quantile_cont(mean_kwh, 0.5) FROM stats) AS med
FROM (SELECT r.account, r.route, t.mean_kwh AS kwh, t.mean_kwh < t.base_kwh * 0.7 AS mean_low, z.zs, CASE WHEN r.route LIKE '%R1' THEN 0.4::DOUBLE ELSE 0.1 END AS est, r.account % 31 = 0 AS unlinked
  FROM register r JOIN stats t USING (account) JOIN (SELECT account, avg(CASE WHEN kwh = 0 THEN 1.0::DOUBLE ELSE 0 END) AS zs FROM readings GROUP BY 1) z USING (account)) GROUP BY route HAVING count(*) >= 5
""")
cte("route_stat", """
SELECT *, sd / m AS cv, m / med AS ratio, coalesce(list_avg(list_filter([CASE WHEN zero_pct > 20 THEN least(zero_pct / 100, 1) END, CASE WHEN est_pct > 30 THEN least(est_pct / 100, 1) END,
  CASE WHEN m / med < 0.6 THEN least((0.6 - m / med) / 0.6, 1) END, CASE WHEN unlinked > 0 THEN least(unlinked / customers, 1) END], lambda v: v IS NOT NULL)), 0) AS inc FROM route_raw
""")


def routes(spark, d, s=None) -> DataFrame:
    s = s or customer_series(spark, d)
    zero = F.expr("size(filter(series, x -> coalesce(x, -1D) = 0)) / cast(size(series) as double)")
    low = F.col("mean_kwh") < F.col("base_kwh") * 0.7
    return survey.route_statistics(s.select(
        "account", "route", F.col("mean_kwh").alias("kwh"), low.alias("suspect"), F.when(low, 100.0).otherwise(0.0).alias("recoverable_kwh"),
        zero.alias("zero_share"), F.when(F.col("route").endswith("R1"), 0.4).otherwise(0.1).alias("estimated_share"), (F.col("account") % 31 == 0).alias("unlinked")))


@query("route_statistics", """
SELECT route, customers, suspects, round(energy_kwh, 3) AS energy_kwh, round(zero_pct, 4) AS zero_pct, round(est_pct, 4) AS estimated_pct, round(cv, 6) AS cv, round(ratio, 6) AS ratio, unlinked, round(inc, 6) AS incoherence FROM route_stat
""")
def _(spark, d):
    r = routes(spark, d).select("route", "customers", "suspects", "energy_kwh", "zero_pct", "estimated_pct", "cv", "ratio", "unlinked", "incoherence")
    return rounded(r, energy_kwh=3, zero_pct=4, estimated_pct=4, cv=6, ratio=6, incoherence=6)


cte("t_route", f"""
SELECT 'RUTA_COMERCIAL' AS level, route AS entity, NULL::VARCHAR AS feeder, 0.55 * s + 0.45 * {_norm('rec', 'route_stat')} AS priority, s AS suspicion, rec AS kwh, customers, false AS data_problem
FROM (SELECT *, least(1, greatest(0.5 * suspects / customers + 0.5 * {_norm('suspects', 'route_stat')}, inc)) AS s FROM route_stat)
""")


@query("target_routes", _OUT.format("t_route"))
def _(spark, d):
    return out(survey.route_targets(routes(spark, d)))


cte("top_cust", "SELECT * FROM ranking WHERE rank <= 200")
cte("t_cust", f"""
SELECT 'CLIENTE' AS level, CAST(account AS VARCHAR) AS entity, feeder, least(1, 0.55 * score + 0.45 * {_norm('recoverable_kwh', 'top_cust')}) AS priority, score AS suspicion, recoverable_kwh AS kwh, 1::BIGINT AS customers, false AS data_problem, x, y FROM top_cust
""")


def cust_ranking(spark, d, base=None) -> DataFrame:
    columns = ["account", "feeder", "score", "recoverable_kwh", "reasons", "x", "y"]
    return stage(ranking(spark, d, base=base, columns=columns).select("account", "feeder", "rank", *columns[2:]), "ranking")


@query("target_customers", _OUT.format("t_cust"))
def _(spark, d):
    return out(survey.customer_targets(cust_ranking(spark, d)))


cte("sector_cust", "SELECT *, floor(x / 300) AS gx, floor(y / 300) AS gy FROM ranking WHERE rank <= (SELECT count(*) * 0.3 FROM ranking)")
cte("sector_c", "SELECT gx, gy, count(*) AS customers, sum(recoverable_kwh) AS kwh, avg(score) AS mean_score, avg(x) AS cx, avg(y) AS cy, min(feeder) AS feeder FROM sector_cust GROUP BY 1, 2")
cte("sector_stat", """
SELECT c.*, printf('SEC-E%.1f-N%.1f', round_even((gx + 0.5) * 300 / 100, 0) * 100 / 1000, round_even((gy + 0.5) * 300 / 100, 0) * 100 / 1000) AS sector, r.radius_m FROM sector_c c JOIN (
  SELECT u.gx, u.gy, max(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) AS radius_m FROM sector_cust u JOIN sector_c v USING (gx, gy) GROUP BY 1, 2) r USING (gx, gy)
""")
cte("t_sector", f"""
SELECT 'SECTOR' AS level, sector AS entity, feeder, least(1, 0.55 * mean_score + 0.45 * {_norm('kwh', 'sector_stat')}) AS priority, mean_score AS suspicion, kwh, customers, false AS data_problem, cx AS x, cy AS y FROM sector_stat
""")


def sector_parts(spark, d, base=None):
    r = cust_ranking(spark, d, base)
    m = stage(survey.sector_members(survey.most_suspect(r)), "members")
    return r, m, stage(survey.sectors(m), "sectors")


@query("geographic_sectors", "SELECT sector, customers, round(kwh, 3) AS kwh, round(mean_score, 6) AS mean_score, round(radius_m, 4) AS radius_m FROM sector_stat")
def _(spark, d):
    s = sector_parts(spark, d)[2]
    return rounded(s.select("sector", "customers", "kwh", "mean_score", "radius_m"), kwh=3, mean_score=6, radius_m=4)


@query("target_sectors", _OUT.format("t_sector"))
def _(spark, d):
    return out(survey.sector_targets(sector_parts(spark, d)[2]))


cte("t_org", f"""
SELECT level, CASE WHEN level = 'SUBESTACION' THEN substation ELSE unit END AS entity, 0.45 * CASE level WHEN 'SUBESTACION' THEN (ntl_kwh - s.lo) / (s.hi - s.lo) ELSE (ntl_kwh - u.lo) / (u.hi - u.lo) END
  + 0.55 * least(round(ntl_kwh / input_kwh * 100, 2) / 100 * 5, 1) AS priority, round(ntl_kwh / input_kwh * 100, 2) / 100 AS suspicion, ntl_kwh AS kwh, 0::BIGINT AS customers, false AS data_problem
FROM rolled, (SELECT min(ntl_kwh) AS lo, max(ntl_kwh) AS hi FROM rolled WHERE level = 'SUBESTACION') s, (SELECT min(ntl_kwh) AS lo, max(ntl_kwh) AS hi FROM rolled WHERE level = 'UNIDAD_NEGOCIO') u
""")


@query("target_organisation", _OUT.format("t_org"))
def _(spark, d):
    return out(survey.organisation_targets(rolled(spark, d)))


_PLAN = ["level", "entity", "feeder", "priority", "suspicion", "kwh", "customers", "data_problem"]
cte("survey_plan", "\nUNION ALL ".join(
    f"SELECT {', '.join(_PLAN[:-1])}, coalesce(data_problem OR feeder IN (SELECT fa FROM tr_found UNION SELECT fb FROM tr_found), data_problem) AS data_problem FROM {t}" if t not in ("t_org",)
    else f"SELECT level, entity, NULL::VARCHAR AS feeder, {', '.join(_PLAN[3:])} FROM {t}"
    for t in ("t_feeder", "t_zone", "t_branch", "t_site", "t_route", "t_cust", "t_sector", "t_org")), kept=True)


def the_plan(spark, d):
    """All nine levels, targets in the feeders of a detected transfer degraded; members and sectors for the orders."""
    # Staged once for all levels that read them: customers with their series, customers on nodes, balances, the tree.
    base = averaged(spark, d)
    r, m, s = sector_parts(spark, d, base)
    net, c, b = walk(spark, d), stage(node_customers(spark, d), "nodes"), stage(balances(spark, d), "balances")
    p = survey.plan(
        feeder_t(spark, d, b), zone_t(spark, d, net, c), branch_t(spark, d, net, c), site_t(spark, d, net, c),
        survey.route_targets(routes(spark, d, base)), survey.customer_targets(r), survey.sector_targets(s),
        survey.organisation_targets(stage(rolled(spark, d, b), "rolled")))
    moved = transfers.affected_feeders(transfers.transfer_candidates(residuals(spark, d)))
    return m, s, stage(survey.degrade_transferred(p, moved), "plan")


@query("survey_plan_summary", "SELECT level, count(*) AS targets, count(*) FILTER (WHERE data_problem) AS data_problems, round(sum(kwh), 2) AS kwh FROM survey_plan GROUP BY 1")
def _(spark, d):
    return rounded(survey.plan_summary(the_plan(spark, d)[2]), kwh=2)


@query("survey_plan", "SELECT level, entity, feeder, round(priority, 6) AS priority, round(suspicion, 6) AS suspicion, round(kwh, 3) AS kwh, customers, data_problem FROM survey_plan")
def _(spark, d):
    return rounded(the_plan(spark, d)[2].select(*_PLAN), priority=6, suspicion=6, kwh=3)


@query("work_orders", """
WITH e AS (
  SELECT level, entity, round(kwh, 6) AS kwh, round(suspicion, 9) AS suspicion FROM survey_plan
  WHERE level IN ('PUESTO_TRANSFORMACION', 'RUTA_COMERCIAL', 'SECTOR', 'CLIENTE') AND NOT data_problem),
m AS (SELECT CAST(u.account AS VARCHAR) AS account, v.sector FROM sector_cust u JOIN sector_stat v USING (gx, gy)),
c AS (SELECT DISTINCT c.entity FROM e c JOIN m ON m.account = c.entity JOIN e s ON s.level = 'SECTOR' AND s.entity = m.sector WHERE c.level = 'CLIENTE' AND (s.kwh > c.kwh OR (s.kwh = c.kwh AND s.suspicion >= c.suspicion))),
o AS (SELECT *, row_number() OVER (ORDER BY kwh DESC, suspicion DESC, level, entity) AS n FROM e WHERE NOT (level = 'CLIENTE' AND entity IN (SELECT entity FROM c)))
SELECT printf('OT-%04d', n) AS work_order, level, entity, round(kwh, 3) AS kwh FROM o WHERE n <= 50
""")
def _(spark, d):
    m, s, p = the_plan(spark, d)
    p = p.withColumns({"suspicion": F.round("suspicion", 9), "kwh": F.round("kwh", 6)})
    members = m.join(s.select("cell_x", "cell_y", "sector"), ["cell_x", "cell_y"]).select(F.lit("SECTOR").alias("level"), F.col("sector").alias("entity"), "account")
    return rounded(survey.work_orders(p, members).select("work_order", "level", "entity", "kwh"), kwh=3)


@query("location_registry", """
WITH l AS (SELECT printf('UBI-E%.1f-N%.1f', round_even((600000 + (event_id * 7919) % 2000) / 100.0, 0) * 100 / 1000, round_even((9700000 + (user_id * 104) % 900) / 100.0, 0) * 100 / 1000) AS location,
  value AS priority, event_type AS entity, CAST(ts AS DATE) AS day FROM events)
SELECT location, min(day) AS first_seen, max(day) AS last_seen, count(DISTINCT day) AS times, max(priority) AS priority_max, count(DISTINCT entity) AS entities, count(DISTINCT day) >= 3 AS recurrent FROM l GROUP BY 1
""")
def _(spark, d):
    e = table(spark, d, "events").select(
        F.lit("OTRO").alias("level"), (600000 + (F.col("event_id") * 7919) % 2000).cast("double").alias("x"),
        (9700000 + (F.col("user_id") * 104) % 900).cast("double").alias("y"), F.col("value").alias("priority"), F.col("event_type").alias("entity"), "ts")
    r = survey.locations(survey.location_log(e, F.to_date("ts")))
    return r.select("location", "first_seen", "last_seen", "times", "priority_max", "entities", "recurrent")


# --- field work ----------------------------------------------------------------

def work_customers(spark, d) -> DataFrame:
    return register(spark, d).select("account", "feeder", "x", "y", (F.col("p_prev_kw") * 10).alias("recoverable_kwh"))


@query("work_blocks", """
WITH c AS (SELECT account, x, y FROM register WHERE feeder IN ('F001', 'F002', 'F003')),
b AS (SELECT min(x) AS x0, min(y) AS y0, greatest(sqrt(greatest(max(x) - min(x), 1) * greatest(max(y) - min(y), 1) / greatest(1, ceil(count(*) / 20.0))), 1) AS side FROM c),
g AS (SELECT account, floor((x - x0) / side) AS cx, floor((y - y0) / side) AS cy FROM c, b)
SELECT account, CAST(ceil(row_number() OVER (ORDER BY cy, CASE WHEN cy % 2 = 0 THEN cx ELSE -cx END, account) / 20.0) AS INTEGER) AS block FROM g
""")
def _(spark, d):
    c = fieldwork.select_feeders(work_customers(spark, d), ["F001", "F002", "F003"])
    return fieldwork.compact_blocks(c, 20).select("account", "block")


@query("campaign_orders", """
SELECT 'OT-' || lpad(CAST(row_number() OVER (ORDER BY camp, work_order) AS VARCHAR), 6, '0') AS work_order, campaign, kwh, customers FROM (
  SELECT 0 AS camp, 'OT-' || lpad(CAST(account // 100 AS VARCHAR), 5, '0') AS work_order, 'INSPECCION_PNT' AS campaign, round(sum(p_prev_kw * 10), 1) AS kwh, count(*) AS customers FROM register GROUP BY account // 100
  UNION ALL SELECT 1, 'OT-' || lpad(CAST(account // 200 AS VARCHAR), 5, '0'), 'CENSO', 0.0, count(*) FROM register GROUP BY account // 200)
""")
def _(spark, d):
    w = work_customers(spark, d)
    blocks = lambda n: w.withColumn("block", F.floor(F.col("account") / n).cast("int"))
    a = fieldwork.orders_from_blocks(blocks(100), "INSPECCION_PNT")
    b = fieldwork.plan_to_orders(fieldwork.orders_from_blocks(blocks(200), "INSPECCION_PNT"), "CENSO")
    return fieldwork.merge_campaigns(a, b).select("work_order", "campaign", "kwh", "customers")


@query("account_list_work", """
WITH w AS (SELECT DISTINCT o_custkey + 20 AS account FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT account, account IN (SELECT account FROM register) AS found FROM w
""")
def _(spark, d):
    wanted = table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT").select((F.col("o_custkey") + 20).alias("account"))
    found, lost = fieldwork.select_accounts(work_customers(spark, d), wanted)
    return found.select("account", F.lit(True).alias("found")).unionByName(lost.select("account", F.lit(False).alias("found")))


@query("customers_in_circles", """
SELECT r.account, s_suppkey AS centre, round(sqrt(pow(r.x - c.cx, 2) + pow(r.y - c.cy, 2)), 4) AS distance FROM register r JOIN (
  SELECT s_suppkey, 600000.0::DOUBLE + (s_suppkey * 3571) % 20000 AS cx, 9700000.0::DOUBLE + (s_suppkey * 8237) % 20000 AS cy, 200.0::DOUBLE + (s_suppkey % 7) * 150 AS radius FROM supplier) c
ON sqrt(pow(r.x - c.cx, 2) + pow(r.y - c.cy, 2)) <= radius
""")
def _(spark, d):
    k = F.col("s_suppkey")
    circles = table(spark, d, "supplier").select(
        k.alias("centre"), (600000.0 + (k * 3571) % 20000).alias("cx"), (9700000.0 + (k * 8237) % 20000).alias("cy"), (200.0 + (k % 7) * 150).alias("radius"))
    j = rangejoin.circle_join(register(spark, d).select("account", "x", "y"), circles)
    return rounded(j.select("account", "centre", "distance"), distance=4)


@query("nearest_vertex", """
WITH v AS (SELECT p_partkey AS vertex, 600000.0::DOUBLE + (p_partkey * 7919) % 20000 + (p_size % 5) AS vx, 9700000.0::DOUBLE + (p_partkey * 10473) % 20000 + (p_size % 3) AS vy FROM part)
SELECT account, vertex, round(dist, 6) AS distance FROM (SELECT account, vertex, sqrt(pow(x - vx, 2) + pow(y - vy, 2)) AS dist, row_number() OVER (PARTITION BY account ORDER BY sqrt(pow(x - vx, 2) + pow(y - vy, 2)), vertex) AS rn
  FROM register JOIN v ON abs(x - vx) <= 3 AND abs(y - vy) <= 3 WHERE sqrt(pow(x - vx, 2) + pow(y - vy, 2)) <= 3) WHERE rn = 1
""")
def _(spark, d):
    k = F.col("p_partkey")
    v = table(spark, d, "part").select(
        k.alias("vertex"), (600000.0 + (k * 7919) % 20000 + F.col("p_size") % 5).alias("vx"), (9700000.0 + (k * 10473) % 20000 + F.col("p_size") % 3).alias("vy"))
    return rounded(rangejoin.nearest_within(register(spark, d).select("account", "x", "y"), v, point_id="account", vertex_id="vertex"), distance=6)


def _crew_orders(spark, d):
    k = F.col("account")
    o = register(spark, d).select(
        k.alias("work_order"), F.concat(F.lit("U"), F.col("division")).alias("unit"), F.round(F.col("p_prev_kw") * 100, 0).alias("weight"), "x", "y")
    crews = table(spark, d, "supplier").select(
        F.concat(F.lit("U"), (F.col("s_nationkey") % 5).cast("string")).alias("unit"), F.concat(F.lit("C"), (F.col("s_suppkey") % 20).cast("string")).alias("crew")).distinct()
    return o, crews


cte("crew_orders", "SELECT account AS work_order, 'U' || division AS unit, round(p_prev_kw * 100, 0) AS weight, x, y FROM register")
cte("crew_slots", """
SELECT unit, crew, row_number() OVER (PARTITION BY unit ORDER BY crew) - 1 AS slot FROM (SELECT DISTINCT 'U' || (s_nationkey % 5) AS unit, 'C' || (s_suppkey % 20) AS crew FROM supplier)
""")
cte("crew_tiers", """
SELECT o.*, n.crews, (row_number() OVER (PARTITION BY o.unit ORDER BY weight DESC, work_order) - 1) // n.crews AS tier, atan2(y - cy, x - cx) AS angle
FROM crew_orders o LEFT JOIN (SELECT unit, count(*) AS crews FROM crew_slots GROUP BY 1) n ON o.unit = n.unit
LEFT JOIN (SELECT unit, avg(x) AS cx, avg(y) AS cy FROM crew_orders GROUP BY 1) c ON o.unit = c.unit
""")
cte("crew_placed", "SELECT t.*, row_number() OVER (PARTITION BY unit, tier ORDER BY angle, work_order) - 1 AS slot FROM crew_tiers t")


@query("crew_assignment", """
SELECT work_order, p.unit, CASE WHEN tier < 40 THEN crew END AS crew, tier, CASE WHEN crews IS NULL THEN 'SIN_CUADRILLA' WHEN tier >= 40 THEN 'CUPO' END AS leftover
FROM crew_placed p LEFT JOIN crew_slots s ON p.unit = s.unit AND p.slot = s.slot AND p.crews IS NOT NULL
""")
def _(spark, d):
    return fieldwork.distribute(*_crew_orders(spark, d), cap=40).select("work_order", "unit", "crew", "tier", "leftover")


@query("crew_balance", """
SELECT unit, count(*) AS crews, round(coalesce((max(w) - min(w)) / nullif(avg(w), 0) * 100, 0), 6) AS imbalance_pct FROM (
  SELECT p.unit, crew, sum(weight) AS w FROM crew_placed p JOIN crew_slots s ON p.unit = s.unit AND p.slot = s.slot GROUP BY 1, 2) GROUP BY 1
""")
def _(spark, d):
    a = stage(fieldwork.distribute(*_crew_orders(spark, d)), "assigned")
    return rounded(fieldwork.imbalance(fieldwork.assignment_metrics(a)), imbalance_pct=6)


@query("assignment_metrics", """
WITH a AS (SELECT account, 'U' || division AS unit, 'C' || (account % 7) AS crew, round(p_prev_kw * 100, 0) AS weight, x, y FROM register),
c AS (SELECT unit, crew, count(*) AS orders, sum(weight) AS weight, avg(x) AS cx, avg(y) AS cy FROM a GROUP BY 1, 2)
SELECT unit, crew, c.orders, c.weight, round(avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) / 1000, 6) AS spread_km FROM a JOIN c USING (unit, crew) GROUP BY 1, 2, 3, 4
""")
def _(spark, d):
    o, _c = _crew_orders(spark, d)
    a = o.withColumn("crew", F.concat(F.lit("C"), (F.col("work_order") % 7).cast("string")))
    return rounded(fieldwork.assignment_metrics(a), spread_km=6)


_STATE = "CASE event_id % 5 WHEN 0 THEN 'ASIGNADA' WHEN 1 THEN 'DESCARGADA' WHEN 2 THEN 'EN_PROCESO' WHEN 3 THEN 'COMPLETADA' ELSE 'SINCRONIZADA' END"


def order_events(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("event_id")
    st = F.when(k % 5 == 0, "ASIGNADA").when(k % 5 == 1, "DESCARGADA").when(k % 5 == 2, "EN_PROCESO").when(k % 5 == 3, "COMPLETADA").otherwise("SINCRONIZADA")
    return e.select(k.alias("id"), F.col("user_id").alias("work_order"), F.concat(F.lit("C"), (F.col("user_id") % 9).cast("string")).alias("crew"), st.alias("state"),
                    F.col("ts").alias("at"), F.col("ts").alias("assigned_at"), F.when(k % 3 == 0, F.date_format(F.col("ts") + F.expr("interval 2 days"), "yyyy-MM-dd HH:mm:ss")).otherwise("").alias("last_progress"),
                    (k % 4 + 1).alias("customers"), F.floor("value").cast("double").alias("kwh"))


@query("crew_workload", f"""
SELECT c.crew, coalesce(count(o.crew), 0) AS orders, coalesce(sum(cu), 0)::BIGINT AS customers, coalesce(sum(kwh), 0) AS kwh, """ + ", ".join(
    f"count(*) FILTER (WHERE state = '{s}') AS {s.lower()}" for s in fieldwork.STATES) + f"""
FROM (SELECT DISTINCT 'C' || (s_suppkey % 12) AS crew FROM supplier) c LEFT JOIN (SELECT 'C' || (user_id % 9) AS crew, {_STATE} AS state, event_id % 4 + 1 AS cu, floor(value) AS kwh FROM events) o USING (crew) GROUP BY 1
""")
def _(spark, d):
    crews = table(spark, d, "supplier").select(F.concat(F.lit("C"), (F.col("s_suppkey") % 12).cast("string")).alias("crew"))
    return fieldwork.crew_workload(crews, order_events(spark, d))


@query("stalled_orders", f"""
SELECT event_id AS id FROM (SELECT event_id, {_STATE} AS state, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) + INTERVAL 2 DAY ELSE ts END AS last FROM events)
WHERE state IN ('ASIGNADA', 'DESCARGADA', 'EN_PROCESO') AND last < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 DAY
""")
def _(spark, d):
    return fieldwork.stalled_orders(order_events(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("id")


@query("illegal_transitions", f"""
SELECT work_order, id, previous, state FROM (SELECT user_id AS work_order, event_id AS id, {_STATE} AS state, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
WHERE previous IS NOT NULL AND NOT ((previous = 'ASIGNADA' AND state = 'DESCARGADA') OR (previous = 'DESCARGADA' AND state = 'EN_PROCESO') OR (previous = 'EN_PROCESO' AND state = 'COMPLETADA') OR (previous = 'COMPLETADA' AND state = 'SINCRONIZADA'))
""")
def _(spark, d):
    return fieldwork.illegal_transitions(order_events(spark, d).select("work_order", "at", "state", "id"))


@query("unit_scope", "SELECT account FROM register r JOIN hierarchy h USING (feeder) WHERE unit IN ('ASIA', 'EUROPE')")
def _(spark, d):
    return fieldwork.scope(register(spark, d).select("account", "feeder"), ["ASIA", "EUROPE"], hierarchy=hierarchy(spark, d)).select("account")


@query("entity_resolution", """
SELECT 'ALIMENTADOR' AS level, feeder AS entity, unit, 1::BIGINT AS feeders FROM hierarchy
UNION ALL SELECT 'SUBESTACION', substation, CASE WHEN count(DISTINCT unit) = 1 THEN min(unit) ELSE '' END, count(DISTINCT feeder) FROM hierarchy GROUP BY substation
UNION ALL SELECT 'UNIDAD_NEGOCIO', unit, unit, count(DISTINCT feeder) FROM hierarchy GROUP BY unit
""")
def _(spark, d):
    return fieldwork.resolve_entities(hierarchy(spark, d))


# --- journal -------------------------------------------------------------------

def changes(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    k, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    return e.select(
        F.concat(F.lit("P"), (u % 10).cast("string")).alias("package"), F.when(u % 10 == 9, F.lit("")).otherwise(F.concat(F.lit("tec"), (u % 10).cast("string"))).alias("owner"),
        k.alias("seq"), F.when(u % 2 == 0, "cliente").otherwise("tramo").alias("layer"),
        F.when(k % 501 == 0, "").otherwise(F.concat(F.lit("E"), u.cast("string"))).alias("element"),
        F.when(t == "signup", "CREAR").when(t == "click", "MOVER").when(t == "purchase", "RECONECTAR").when(t == "error", "ELIMINAR").otherwise("MODIFICAR").alias("operation"),
        F.when(k % 7 == 0, "").otherwise("tension").alias("field"),
        F.concat(F.lit("E"), (k % 50).cast("string")).alias("before"), F.when(k % 203 == 0, F.lit(None)).otherwise(F.concat(F.lit("E"), (F.get_json_object("props", "$.k").cast("int") % 50).cast("string"))).alias("after"),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("tec"), (u % 10).cast("string"))).alias("author"), F.col("value").alias("precision_m"),
        F.when(k % 4 == 0, "1").otherwise("0").alias("synced"), F.when(k % 6 == 5, k - 1).alias("propagated_from"), F.col("ts").alias("at"))


cte("changes", """
SELECT 'P' || (user_id % 10) AS package, CASE WHEN user_id % 10 = 9 THEN '' ELSE 'tec' || (user_id % 10) END AS owner, event_id AS seq, CASE WHEN user_id % 2 = 0 THEN 'cliente' ELSE 'tramo' END AS layer,
  CASE WHEN event_id % 501 = 0 THEN '' ELSE 'E' || user_id END AS element, CASE event_type WHEN 'signup' THEN 'CREAR' WHEN 'click' THEN 'MOVER' WHEN 'purchase' THEN 'RECONECTAR' WHEN 'error' THEN 'ELIMINAR' ELSE 'MODIFICAR' END AS operation,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE 'tension' END AS field, 'E' || (event_id % 50) AS before, CASE WHEN event_id % 203 = 0 THEN NULL ELSE 'E' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 50) END AS after,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE 'tec' || (user_id % 10) END AS author, value AS precision_m, event_id % 4 = 0 AS synced, CASE WHEN event_id % 6 = 5 THEN event_id - 1 END AS propagated_from, ts AS edited_at
FROM events
""")
cte("fresh", "SELECT * REPLACE (CASE WHEN author = '' THEN owner ELSE author END AS author), author = '' AS author_filled FROM changes WHERE NOT synced")


@query("journal_intake", "SELECT package, seq, author, author_filled FROM fresh")
def _(spark, d):
    return journal.intake(changes(spark, d)).select("package", "seq", "author", "author_filled")


@query("journal_intake_summary", """
SELECT package, count(*) FILTER (WHERE synced) AS already_synced, count(*) FILTER (WHERE NOT synced) AS "new", count(*) FILTER (WHERE NOT synced AND author = '') AS authors_filled FROM changes GROUP BY 1
""")
def _(spark, d):
    return journal.intake_summary(changes(spark, d))


cte("checks", """
SELECT package, 'SYNC11' AS "check", max(seq) - min(seq) + 1 - count(DISTINCT seq) AS n FROM fresh GROUP BY 1
UNION ALL SELECT package, 'SYNC12', count(*) FROM fresh WHERE author = '' GROUP BY 1
UNION ALL SELECT package, 'SYNC16', count(*) FILTER (WHERE author_filled) FROM fresh GROUP BY 1 HAVING count(*) FILTER (WHERE author = '') = 0
UNION ALL SELECT package, 'SYNC13', count(*) FROM fresh WHERE operation IN ('CREAR', 'MOVER') AND precision_m > 25 GROUP BY 1
UNION ALL SELECT package, 'SYNC15', count(*) FROM fresh WHERE element = '' GROUP BY 1
UNION ALL SELECT package, 'SYNC17', count(*) FROM fresh WHERE operation = 'RECONECTAR' AND after IS NULL GROUP BY 1
UNION ALL SELECT package, 'SYNC18', count(*) FROM fresh WHERE operation = 'RECONECTAR' AND before IS NOT DISTINCT FROM after GROUP BY 1
UNION ALL SELECT package, 'SYNC02', 1 FROM (SELECT DISTINCT package FROM changes) WHERE package = 'P3'
UNION ALL SELECT package, 'SYNC03', 1 FROM (SELECT DISTINCT package FROM changes) WHERE package IN ('P1', 'P3', 'P5', 'P7', 'P9')
UNION ALL SELECT DISTINCT 'P' || (s_suppkey % 18), 'SYNC10', 1 FROM supplier WHERE s_suppkey % 18 > 9
""")
_SEV = """CASE WHEN "check" IN ('SYNC02', 'SYNC11', 'SYNC12', 'SYNC15', 'SYNC17', 'SYNC20') THEN 'BLOQUEANTE' WHEN "check" = 'SYNC19' THEN 'INFORMATIVO' ELSE 'ADVERTENCIA' END"""


def packages(spark, d) -> DataFrame:
    k = (F.col("s_suppkey") % 18)
    name = F.concat(F.lit("P"), k.cast("string"))
    owner = F.when(k % 10 == 9, F.lit("")).otherwise(F.concat(F.lit("tec"), (k % 10).cast("string")))
    return table(spark, d, "supplier").select(
        name.alias("package"), owner.alias("owner"), F.when(k == 3, F.lit("otro")).otherwise(owner).alias("uploaded_by"),
        F.when((k % 2 == 1) & (k < 10), "v1").otherwise("v2").alias("version")).distinct()


@query("journal_checks", f"SELECT package, \"check\", {_SEV} AS severity, n AS \"count\" FROM checks WHERE n > 0")
def _(spark, d):
    return journal.validate_batches(packages(spark, d), changes(spark, d), network_version="v2")


def reviewed(spark, d):
    c = journal.intake(changes(spark, d))
    dec = c.where(F.col("seq") % 5 != 0).select("package", "seq", F.when(F.col("seq") % 3 == 0, "RECHAZADO").otherwise("ACEPTADO").alias("decision"), F.lit("sup").alias("reviewer"))
    found = packages(spark, d).where(F.col("package").isin("P2", "P4")).select("package", F.lit("BLOQUEANTE").alias("severity"))
    return journal.review(c, dec, found)


cte("reviewed0", """
SELECT *, CASE WHEN package IN ('P2', 'P4') THEN 'PENDIENTE' WHEN seq % 5 = 0 THEN 'PENDIENTE' WHEN seq % 3 = 0 THEN 'RECHAZADO' ELSE 'ACEPTADO' END AS s0 FROM fresh
""")
cte("reviewed", """
SELECT c.*, c.s0 AS state, c.s0 = 'RECHAZADO' AND EXISTS (
  SELECT 1 FROM reviewed0 o JOIN reviewed0 a ON a.package = o.package AND a.element = o.element AND a.s0 = 'ACEPTADO'
  WHERE o.package = c.package AND o.seq = c.propagated_from) AS inconsistent
FROM reviewed0 c
""")


@query("journal_review", "SELECT package, seq, state, inconsistent FROM reviewed")
def _(spark, d):
    return reviewed(spark, d).select("package", "seq", "state", "inconsistent")


cte("accepted", "SELECT * FROM reviewed WHERE state = 'ACEPTADO'")
cte("touched", """
SELECT DISTINCT package, element FROM (SELECT package, element FROM accepted UNION ALL SELECT package, before FROM accepted WHERE operation = 'RECONECTAR' UNION ALL SELECT package, after FROM accepted WHERE operation = 'RECONECTAR')
WHERE element IS NOT NULL AND element <> ''
""")
cte("element_feeder", "SELECT 'E' || c_custkey AS element, 'F' || c_nationkey AS feeder FROM customer")


@query("change_impact", """
WITH m(op, st) AS (VALUES ('RECONECTAR', ['topologia', 'flujo', 'perdidas', 'balance', 'focalizacion', 'ranking']), ('CREAR', ['topologia', 'flujo', 'perdidas', 'balance', 'focalizacion']),
  ('ELIMINAR', ['topologia', 'flujo', 'perdidas', 'balance', 'focalizacion']), ('MOVER', ['perdidas', 'flujo', 'balance', 'focalizacion']), ('MODIFICAR', ['perdidas', 'flujo', 'balance'])),
s AS (SELECT package, string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages FROM (SELECT package, unnest(st) AS stage FROM accepted JOIN m ON op = operation
  UNION ALL SELECT package, unnest(['ranking', 'focalizacion']) FROM accepted WHERE layer = 'cliente') GROUP BY 1)
SELECT n.package, n.changes, n.reconnections, e.elements, e.feeders, s.stages FROM (SELECT package, count(*) AS changes, count(*) FILTER (WHERE operation = 'RECONECTAR') AS reconnections FROM accepted GROUP BY 1) n
LEFT JOIN (SELECT package, count(DISTINCT element) AS elements, count(DISTINCT feeder) AS feeders FROM touched LEFT JOIN element_feeder USING (element) GROUP BY 1) e USING (package) LEFT JOIN s USING (package)
""")
def _(spark, d):
    acc = reviewed(spark, d).where(F.col("state") == "ACEPTADO")
    fo = table(spark, d, "customer").select(F.concat(F.lit("E"), F.col("c_custkey").cast("string")).alias("element"), F.concat(F.lit("F"), F.col("c_nationkey").cast("string")).alias("feeder"))
    return journal.impact(acc, fo).withColumn("stages", F.array_join("stages", ","))


def history(spark, d) -> DataFrame:
    c = journal.intake(changes(spark, d))
    return journal.history_rows(c.where(F.col("seq") % 2 == 0), "ARCHIVO").unionByName(journal.history_rows(c.where(F.col("seq") % 2 == 1), "MOVIL"))


@query("history_by_origin", """
SELECT CASE WHEN seq % 2 = 0 THEN 'ARCHIVO' ELSE 'MOVIL' END AS origin, count(*) AS changes, count(DISTINCT element) AS elements, count(DISTINCT author) AS authors FROM fresh GROUP BY 1
""")
def _(spark, d):
    return journal.history_by_origin(history(spark, d))


@query("element_changes", "SELECT seq, operation, author FROM fresh WHERE element = 'E7'")
def _(spark, d):
    return journal.element_history(history(spark, d), "E7").select("seq", "operation", "author")


@query("most_edited_elements", "SELECT element, count(*) AS changes, count(DISTINCT author) AS authors, max(edited_at) AS last FROM fresh GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, d):
    return journal.most_edited(history(spark, d))


def _domain_tables(spark, d):
    """Attribute values from the parts, domains as short fixed lists."""
    p = table(spark, d, "part")
    el = F.concat(F.lit("X"), F.col("p_partkey").cast("string"))
    sub = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "MT").otherwise("BT")
    values = p.select(el.alias("element"), F.lit("tramo").alias("layer"), sub.alias("subtype"), F.inline(F.array(
        F.struct(F.lit("tension").alias("field"), F.when(F.col("p_size") % 4 == 0, "220").when(F.col("p_size") % 4 == 1, "13800").when(F.col("p_size") % 4 == 2, "").otherwise("69000").alias("value")),
        F.struct(F.lit("fases").alias("field"), F.when(F.col("p_size") % 5 == 0, "AB").otherwise("ABC").alias("value")),
        F.struct(F.lit("largo").alias("field"), F.col("p_size").cast("string").alias("value")))))
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    base = one([("tramo", "tension", "D_ALL", True), ("tramo", "fases", "D_FASES", False), ("tramo", "largo", "D_LARGO", False)], "layer string, field string, domain string, mandatory boolean")
    subs = one([("tramo", "MT", "tension", "D_MT", False, False), ("tramo", "BT", "tension", "D_BT", False, False), ("tramo", "BT", "largo", None, False, True)],
               "layer string, subtype string, field string, domain string, mandatory boolean, hidden boolean")
    rules = one([("tramo", "fases", "tension", "220", "D_DOS", 1)], "layer string, field string, when_field string, when_value string, domain string, priority int")
    codes = one([("D_ALL", c) for c in ("220", "13800")] + [("D_MT", "13800"), ("D_BT", "220"), ("D_FASES", "ABC"), ("D_FASES", "AB"), ("D_DOS", "AB")], "domain string, code string")
    ranges = one([("D_LARGO", 1.0, 40.0)], "domain string, lo double, hi double")
    defaults = one([("tramo", "BT", "tension", "220"), ("tramo", "BT", "fases", "AB")], "layer string, subtype string, field string, default string")
    return values, base, subs, rules, codes, ranges, defaults


cte("attr", """
SELECT 'X' || p_partkey AS element, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'MT' ELSE 'BT' END AS subtype, CASE p_size % 4 WHEN 0 THEN '220' WHEN 1 THEN '13800' WHEN 2 THEN '' ELSE '69000' END AS tension,
  CASE WHEN p_size % 5 = 0 THEN 'AB' ELSE 'ABC' END AS fases, p_size AS largo FROM part
""")


@query("domain_violations", """
SELECT element, 'tension' AS field, tension AS value, CASE WHEN tension = '' THEN 'OBLIGATORIO' ELSE 'FUERA_DE_DOMINIO' END AS problem FROM attr
WHERE tension = '' OR NOT CASE subtype WHEN 'MT' THEN tension = '13800' WHEN 'BT' THEN tension = '220' ELSE tension IN ('220', '13800') END
UNION ALL SELECT element, 'fases', fases, 'FUERA_DE_DOMINIO' FROM attr WHERE tension = '220' AND fases <> 'AB'
UNION ALL SELECT element, 'largo', CAST(largo AS VARCHAR), 'FUERA_DE_DOMINIO' FROM attr WHERE subtype <> 'BT' AND NOT largo BETWEEN 1 AND 40
""")
def _(spark, d):
    v, b, s, r, c, g, _x = _domain_tables(spark, d)
    return journal.domain_violations(v, b, s, r, c, g).select("element", "field", "value", "problem")


@query("bulk_subtype_change", """
SELECT element, 'tension' AS field, tension AS before, '220' AS after, CASE WHEN tension = '' THEN 'POR_DEFECTO' WHEN tension = '220' THEN 'CONSERVADO' ELSE 'AJUSTADO' END AS status FROM attr
UNION ALL SELECT element, 'fases', fases, CASE WHEN tension IN ('', '220') THEN 'AB' ELSE fases END, CASE WHEN tension IN ('', '220') AND fases <> 'AB' THEN 'AJUSTADO' ELSE 'CONSERVADO' END FROM attr
UNION ALL SELECT element, 'largo', CAST(largo AS VARCHAR), NULL, 'DESCARTADO' FROM attr
""")
def _(spark, d):
    v, b, s, r, c, g, df = _domain_tables(spark, d)
    new = v.select("element").distinct().withColumn("subtype", F.lit("BT"))
    return journal.change_subtype(v, new, b, s, r, c, g, df).select("element", "field", "before", "after", "status")


# --- scenarios -------------------------------------------------------------------

def scenario_changes(spark, d) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").select(
        F.concat(F.lit("E"), (k % 3).cast("string")).alias("scenario"), k.alias("seq"),
        F.when(k % 50 == 7, "poste").otherwise("cliente").alias("layer"), (F.col("user_id") * F.when(k % 40 == 3, 1000000).otherwise(1)).cast("string").alias("element"),
        F.when(F.col("event_type") == "error", "CREAR").otherwise("MODIFICAR").alias("operation"), F.when(k % 30 == 1, "").otherwise("kwh").alias("field"), F.floor("value").cast("string").alias("after"))


cte("sc_changes", """
SELECT 'E' || (event_id % 3) AS scenario, event_id AS seq, CASE WHEN event_id % 50 = 7 THEN 'poste' ELSE 'cliente' END AS layer, CAST(user_id * CASE WHEN event_id % 40 = 3 THEN 1000000 ELSE 1 END AS VARCHAR) AS element,
  CASE WHEN event_type = 'error' THEN 'CREAR' ELSE 'MODIFICAR' END AS operation, CASE WHEN event_id % 30 = 1 THEN '' ELSE 'kwh' END AS field, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS after FROM events
""")
cte("sc_reason", """
SELECT *, CASE WHEN operation NOT IN ('MODIFICAR', 'RECONECTAR') THEN 'OPERACION_NO_EVALUABLE' WHEN layer <> 'cliente' THEN 'CAPA_DESCONOCIDA'
  WHEN element NOT IN (SELECT CAST(k AS VARCHAR) FROM gload) THEN 'ELEMENTO_AUSENTE' WHEN field = '' THEN 'SIN_CAMPO' END AS reason FROM sc_changes
""")
cte("sc_last", "SELECT scenario, element, max_by(after, seq) AS after FROM sc_reason WHERE reason IS NULL GROUP BY 1, 2")
cte("sc_values", """
SELECT s.scenario, CAST(g.k AS VARCHAR) AS element, g.feeder, coalesce(l.after, CAST(CAST(g.kwh AS BIGINT) AS VARCHAR)) AS value, l.after IS NOT NULL AS changed
FROM (SELECT DISTINCT x.scenario, y.feeder FROM sc_last x JOIN gload y ON CAST(y.k AS VARCHAR) = x.element) s JOIN gload g ON g.feeder = s.feeder LEFT JOIN sc_last l ON l.scenario = s.scenario AND l.element = CAST(g.k AS VARCHAR)
""")


def scenario_values(spark, d) -> DataFrame:
    return node_customers(spark, d).select("feeder", F.lit("cliente").alias("layer"), F.col("account").cast("string").alias("element"), F.lit("kwh").alias("field"), F.col("energy_kwh").cast("bigint").cast("string").alias("value"))


@query("scenario_not_applied", "SELECT scenario, seq, reason FROM sc_reason WHERE reason IS NOT NULL")
def _(spark, d):
    return scenarios.not_applied(scenario_changes(spark, d), scenario_values(spark, d), ["cliente"]).select("scenario", "seq", "reason")


@query("scenario_overlay", "SELECT scenario, element, value, changed FROM sc_values")
def _(spark, d):
    return scenarios.overlay(scenario_values(spark, d), scenario_changes(spark, d), ["cliente"]).select("scenario", "element", "value", "changed")


cte("sc_balance", """
SELECT scenario, feeder, sum(CAST(value AS DOUBLE)) AS billed_kwh, sum(CAST(value AS DOUBLE)) * 0.05::DOUBLE AS technical_kwh, CASE WHEN feeder <> 'G07' THEN 40000.0::DOUBLE END AS head FROM sc_values GROUP BY 1, 2
""")
cte("sc_total", """
SELECT scenario, sum(i) AS input_kwh, sum(billed_kwh) AS billed_kwh, sum(technical_kwh) AS technical_kwh, sum(i - billed_kwh * 1.001 - technical_kwh) AS ntl_kwh, count(*) AS feeders, CASE WHEN bool_or(head IS NULL) THEN 'INDICATIVO' ELSE 'MEDIDO' END AS balance_type
FROM (SELECT *, coalesce(head, billed_kwh * 1.001 / 0.9) AS i FROM sc_balance) GROUP BY 1
""")


def scenario_balance(spark, d) -> DataFrame:
    o = scenarios.overlay(scenario_values(spark, d), scenario_changes(spark, d), ["cliente"])
    g = o.groupBy("scenario", "feeder").agg(F.sum(F.col("value").cast("double")).alias("billed_kwh"))
    b = g.withColumns({"technical_kwh": F.col("billed_kwh") * 0.05, "input_kwh": F.when(F.col("feeder") != "G07", 40000.0)})
    return scenarios.scenario_totals(balance.feeder_balance(b, loss_rate=0.1))


cte("sc_copies", "SELECT DISTINCT scenario, feeder AS home, scenario || '/' || feeder AS feeder FROM sc_values")
cte("sc_load", "SELECT c.scenario, c.feeder, c.home, g.node, g.k, CAST(v.value AS DOUBLE) AS kwh FROM sc_copies c JOIN sc_values v ON v.scenario = c.scenario AND v.feeder = c.home JOIN gnodes g ON CAST(g.k AS VARCHAR) = v.element", kept=True)
cte("sc_watts", "SELECT feeder, home, node, k, (0.0002 * greatest(kwh, 0) + 0.03 * sqrt(greatest(kwh, 0))) * 1000 AS w FROM sc_load")
cte("sc_closure", "SELECT c.feeder, r.node, r.anc FROM rec_closure r JOIN sc_copies c ON c.home = r.feeder")
flow3_ctes("flowsc", "sc_watts", "sc_closure")
cte("sc_site", """
SELECT c.feeder, z.site, z.lighting_kwh, z.kva, t.p0_kw, t.pk_kw, coalesce(b.billed, 0) AS billed FROM sc_copies c JOIN gzone_lv z ON z.feeder = c.home JOIN gtx t ON t.feeder = z.feeder AND t.site = z.site
LEFT JOIN (SELECT l.feeder, p.site, sum(CASE WHEN k % 40 = 20 THEN 0 ELSE l.kwh END) AS billed FROM sc_load l JOIN gplaced p ON p.feeder = l.home AND p.node = l.node WHERE p.site IS NOT NULL GROUP BY 1, 2) b
  ON b.feeder = c.feeder AND b.site = z.site
""")
cte("sc_eval", f"""
SELECT scenario, feeder, i, billed, technical, i - billed * 1.001 - light - technical AS ntl, unmeasured, v FROM (
  SELECT c.scenario, c.home AS feeder, f.v, s.light, s.billed + coalesce(o.billed, 0) AS billed, (f.phases + f.neutral) * 720 * {FACTOR} + s.loss + m.w * 720 / 1000 AS technical, h.input_kwh IS NULL AS unmeasured,
    coalesce(h.input_kwh, (s.billed + coalesce(o.billed, 0)) * 1.001 + s.light) AS i
  FROM sc_copies c JOIN flowsc_sum f USING (feeder)
  JOIN (SELECT feeder, sum(billed) AS billed, sum(lighting_kwh) AS light, sum(p0_kw * 720 + pk_kw * pow((0.0002 * greatest(billed, 0) + 0.03 * sqrt(greatest(billed, 0))) / 0.92 / kva, 2) * 720 * {FACTOR} * 1.02) AS loss FROM sc_site GROUP BY 1) s USING (feeder)
  LEFT JOIN (SELECT l.feeder, sum(l.kwh) AS billed FROM sc_load l LEFT JOIN gplaced p ON p.feeder = l.home AND p.node = l.node WHERE p.site IS NULL AND k % 40 <> 20 GROUP BY 1) o USING (feeder)
  JOIN (SELECT feeder, sum(CASE k % 3 WHEN 0 THEN 0.8 ELSE 1.0 END) AS w FROM gnodes GROUP BY 1) m ON m.feeder = c.home
  LEFT JOIN head_meters h ON h.feeder = c.home)
""")


def scenario_results(spark, d, known: DataFrame | None = None) -> DataFrame:
    overlaid = scenarios.overlay(scenario_values(spark, d), scenario_changes(spark, d), ["cliente"])
    tables = dict(edges=edges(spark, d), sources=sources(spark, d), sites=transformer_sites(spark, d), customers=node_customers(spark, d),
                  lamps=lamps(spark, d), head=head_meters(spark, d))
    return evaluate_scenarios(overlaid, tables, conductor_table(spark, d), SPECS, known)


@query("scenario_feeders", """
SELECT scenario, feeder, round(i, 4) AS input_kwh, billed AS billed_kwh, round(technical, 4) AS technical_kwh, round(ntl, 4) AS ntl_kwh, CASE WHEN unmeasured THEN 'INDICATIVO' ELSE 'MEDIDO' END AS balance_type, round(v, 6) AS v_min_pu FROM sc_eval
""")
def _(spark, d):
    r = scenario_results(spark, d).select("scenario", "feeder", "input_kwh", "billed_kwh", "technical_kwh", "ntl_kwh", "balance_type", "v_min_pu")
    return rounded(r, input_kwh=4, technical_kwh=4, ntl_kwh=4, v_min_pu=6)


@query("scenario_evaluation", """
SELECT scenario, round(sum(i), 2) AS input_kwh, sum(billed) AS billed_kwh, round(sum(technical), 3) AS technical_kwh, round(sum(ntl), 2) AS ntl_kwh, count(*) AS feeders,
  CASE WHEN bool_or(unmeasured) THEN 'INDICATIVO' ELSE 'MEDIDO' END AS balance_type, round(sum(ntl) / sum(i) * 100, 4) AS ntl_pct, round(min(v), 6) AS v_min_pu FROM sc_eval GROUP BY 1
""")
def _(spark, d):
    results = stage(scenario_results(spark, d), "results")
    low = results.groupBy("scenario").agg(F.min("v_min_pu").alias("v_min_pu"))
    t = scenarios.scenario_totals(results).join(low, "scenario")
    return rounded(t.select("scenario", "input_kwh", "billed_kwh", "technical_kwh", "ntl_kwh", "feeders", "balance_type", "ntl_pct", "v_min_pu"),
                   input_kwh=2, technical_kwh=3, ntl_kwh=2, ntl_pct=4, v_min_pu=6)


def iterations(spark, d) -> DataFrame:
    t = stage(scenario_balance(spark, d).select("scenario", "input_kwh", "billed_kwh", "balance_type").withColumn("topology", F.lit("t1")), "totals")
    first = scenarios.next_iteration(t.limit(0).withColumn("iteration", F.lit(0)), t)
    second = t.withColumns({"billed_kwh": F.col("billed_kwh") * 1.5, "topology": F.when(F.col("scenario") == "E1", "t2").otherwise("t1"),
                            "balance_type": F.when(F.col("scenario") == "E2", "MEDIDO").otherwise(F.col("balance_type"))})
    return scenarios.next_iteration(stage(first, "iterations"), second)


@query("scenario_iterations", """
SELECT scenario, 1 AS iteration, billed_kwh FROM sc_total UNION ALL SELECT scenario, 2, billed_kwh * 1.5 FROM sc_total
""")
def _(spark, d):
    return iterations(spark, d).select("scenario", "iteration", "billed_kwh")


@query("scenario_evolution", "SELECT 1 AS iteration, billed_kwh FROM sc_total WHERE scenario = 'E1' UNION ALL SELECT 2, billed_kwh * 1.5 FROM sc_total WHERE scenario = 'E1'")
def _(spark, d):
    return scenarios.evolution(iterations(spark, d), "E1").select("iteration", "billed_kwh")


@query("iteration_comparison", """
SELECT scenario, 'billed_kwh' AS metric, round(billed_kwh * 0.5, 2) AS difference, 50.0::DOUBLE AS pct, scenario = 'E1' AS topology_changed, scenario = 'E2' AS type_changed FROM sc_total
UNION ALL SELECT scenario, 'input_kwh', 0, 0, scenario = 'E1', scenario = 'E2' FROM sc_total
""")
def _(spark, d):
    c = scenarios.compare_iterations(iterations(spark, d), 1, 2, ["billed_kwh", "input_kwh"])
    return rounded(c.select("scenario", "metric", "difference", "pct", "topology_changed", "type_changed"), difference=2)
