"""Credibility, structural peers, validation and inspections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.operators import credibility, entities, inspections, rangejoin, scoring, transfers, validation
from wattledger.operators.balance import with_controls
from wattledger.registry.core import cte, query
from wattledger.registry.customers import ranking, rounded, signal_table
from wattledger.registry.energy import balances, residuals
from wattledger.registry.inputs import code, register, table
from wattledger.staging import stage

# --- linkage ----------------------------------------------------------------


def billing(spark, d) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("account")).agg(
        F.sum(F.floor(F.col("o_totalprice") / 100)).cast("double").alias("kwh"))
    return o.join(register(spark, d).select("account", "route"), "account")


def gis(spark, d) -> DataFrame:
    """Accounts on the network: most customers, a few unknown ones, some blanks."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    k = F.col("c_custkey")
    return c.where(F.col("c_acctbal") >= -450).select(k.cast("string").alias("account")).unionByName(
        c.where(F.col("c_acctbal") > 9900).select(F.concat(F.lit("9999"), k.cast("string")).alias("account"))).unionByName(
        c.where(F.col("c_acctbal") < -950).select(F.lit("nan").alias("account")))


cte("billing", """
SELECT CAST(o_custkey AS VARCHAR) AS account, sum(floor(o_totalprice / 100)) AS kwh, min(route) AS route
FROM orders JOIN register ON o_custkey = register.account GROUP BY 1
""")
cte("gis", """
SELECT CAST(c_custkey AS VARCHAR) AS account FROM customer WHERE c_acctbal >= -450
UNION ALL SELECT '9999' || c_custkey FROM customer WHERE c_acctbal > 9900
""")


@query("unmatched_customers", """
SELECT account, kwh, route, 'CSV_SIN_SIG' AS direction FROM billing WHERE account NOT IN (SELECT account FROM gis)
UNION ALL SELECT DISTINCT account, NULL, NULL, 'SIG_SIN_CSV' FROM gis WHERE account NOT IN (SELECT account FROM billing)
""")
def _(spark, d):
    return credibility.unmatched(billing(spark, d), gis(spark, d))


@query("customer_linkage", """
WITH g AS (SELECT DISTINCT account FROM gis), j AS (SELECT b.account AS ba, g.account AS ga, kwh FROM billing b FULL JOIN g USING (account)),
a AS (SELECT count(ba) AS n_billed, count(ga) AS n_network, count(*) FILTER (WHERE ba IS NOT NULL AND ga IS NOT NULL) AS n_linked,
  sum(kwh) AS e, sum(kwh) FILTER (WHERE ga IS NOT NULL) AS l FROM j)
SELECT n_billed, n_network, n_linked, n_billed - n_linked AS billed_not_network, n_network - n_linked AS network_not_billed,
  round(n_linked * 100.0::DOUBLE / n_billed, 6) AS pct_accounts, round(l * 100 / e, 6) AS pct_energy, e - l AS unlinked_kwh, l * 100 / e >= 95 AS fit_for_measured FROM a
""")
def _(spark, d):
    return rounded(credibility.linkage(billing(spark, d), gis(spark, d)), pct_accounts=6, pct_energy=6)


@query("unmatched_by_route", """
SELECT route, count(*) AS accounts, sum(kwh) AS unlinked_kwh FROM billing WHERE account NOT IN (SELECT account FROM gis) GROUP BY 1
""")
def _(spark, d):
    return credibility.unmatched_by_route(credibility.unmatched(billing(spark, d), gis(spark, d)))


def _coherence(spark, d):
    b = stage(with_controls(balances(spark, d)), "balances")
    moved = transfers.affected_feeders(
        transfers.transfer_candidates(residuals(spark, d)).where(F.col("confidence") > 0.75))
    link = credibility.linkage(billing(spark, d), gis(spark, d))
    conf = b.select("feeder", (F.substring("feeder", 2, 9).cast("int") * 4).cast("double").alias("confidence"))
    return b, stage(credibility.incoherences(b, transferred=moved, link=link, confidence=conf), "incoherences")


cte("incoherence", """
SELECT feeder, code, observed, threshold,
  CASE WHEN code IN ('C01', 'C03') THEN 'BLOQUEANTE' WHEN code = 'C05' THEN 'MEDIA' ELSE 'ALTA' END AS severity,
  code NOT IN ('C01', 'C03') AS publishable, code NOT IN ('C04', 'C05') AS excluded
FROM (SELECT feeder, code, observed, threshold FROM feeder_controls WHERE triggered
  UNION ALL SELECT DISTINCT feeder, 'TRANSFER', NULL, NULL FROM (
    SELECT unnest([fa, fb]) AS feeder FROM tr_found WHERE 0.5 * sym + 0.3 + 0.2 * least(peak / 100, 1) > 0.75)
  UNION ALL SELECT feeder, 'VINCULACION', p, 95 FROM feeder_balance, (
    SELECT sum(kwh) FILTER (WHERE account IN (SELECT account FROM gis)) * 100 / sum(kwh) AS p FROM billing) WHERE p < 95
  UNION ALL SELECT feeder, 'CONFIABILIDAD', CAST(substr(feeder, 2) AS INTEGER) * 4.0, 50 FROM feeder_balance WHERE CAST(substr(feeder, 2) AS INTEGER) * 4 < 50)
""")


@query("feeder_incoherences", """
SELECT feeder, code, round(observed, 4) AS observed, round(threshold, 4) AS threshold, severity, publishable, excluded FROM incoherence
""")
def _(spark, d):
    return rounded(_coherence(spark, d)[1], observed=4, threshold=4)


cte("verdicts", """
SELECT b.feeder, CASE WHEN bool_or(severity = 'BLOQUEANTE') THEN 'BLOQUEANTE' WHEN bool_or(severity = 'ALTA') THEN 'ALTA' WHEN count(code) > 0 THEN 'MEDIA' ELSE 'OK' END AS max_severity,
  count(code) AS findings, coalesce(bool_and(publishable), true) AS publishable, coalesce(bool_or(excluded), false) AS excluded
FROM feeder_balance b LEFT JOIN incoherence i USING (feeder) GROUP BY b.feeder
""")


@query("feeder_verdicts", "SELECT * FROM verdicts")
def _(spark, d):
    return credibility.feeder_verdict(*_coherence(spark, d))


@query("coherence_summary", """
SELECT count(*) AS feeders, count(*) FILTER (WHERE findings > 0) AS incoherent, count(*) FILTER (WHERE max_severity = 'BLOQUEANTE') AS blocking,
  count(*) FILTER (WHERE excluded) AS excluded FROM verdicts
""")
def _(spark, d):
    return credibility.coherence_summary(credibility.feeder_verdict(*_coherence(spark, d)))


# --- structural peers --------------------------------------------------------

def sites(spark, d) -> DataFrame:
    """Entities with structural columns and a metric, from ``supplier`` and ``lineitem``."""
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).cast("double").alias("customers"), F.sum("l_quantity").alias("energy_kwh"),
        F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)), 2).alias("returned"))
    s = table(spark, d, "supplier")
    return li.join(s, li.l_suppkey == s.s_suppkey).select(
        code("T", F.col("s_suppkey"), 6).alias("entity"), F.col("s_nationkey").alias("unit"), "customers", "energy_kwh",
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("kva"),
        (F.col("returned") / F.col("energy_kwh") * 100).alias("ntl_pct"))


cte("sites", """
SELECT 'T' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS entity, s_nationkey AS unit, CAST(count(*) AS DOUBLE) AS customers, sum(l_quantity) AS energy_kwh,
  CASE WHEN s_acctbal > 0 THEN s_acctbal END AS kva, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) * 100 AS ntl_pct
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_nationkey, s_acctbal
""")
cte("site_med", "SELECT quantile_cont(customers, 0.5) AS m1, quantile_cont(energy_kwh, 0.5) AS m2, quantile_cont(kva, 0.5) AS m3 FROM sites")
cte("site_dev", """
SELECT quantile_cont(abs(customers - m1), 0.5) AS d1, quantile_cont(abs(energy_kwh - m2), 0.5) AS d2, quantile_cont(abs(coalesce(kva, m3) - m3), 0.5) AS d3 FROM sites, site_med
""")
cte("site_z", """
SELECT entity, unit, ntl_pct, (customers - m1) / (1.4826 * d1) AS z1, (energy_kwh - m2) / (1.4826 * d2) AS z2, (coalesce(kva, m3) - m3) / (1.4826 * d3) AS z3,
  count(*) OVER (PARTITION BY unit) AS nb FROM sites, site_med, site_dev
""")
cte("site_near", """
SELECT a.entity, b.entity AS peer, sqrt(pow(a.z1 - b.z1, 2) + pow(a.z2 - b.z2, 2) + pow(a.z3 - b.z3, 2)) AS dist, b.ntl_pct AS v, a.ntl_pct AS observed
FROM site_z a JOIN site_z b ON a.entity <> b.entity AND (a.nb < 5 OR a.unit = b.unit)
""")
cte("site_rank", "SELECT *, row_number() OVER (PARTITION BY entity ORDER BY dist, peer) AS rn, count(*) OVER (PARTITION BY entity) AS nc FROM site_near")
cte("site_ref", "SELECT entity, quantile_cont(dist, 0.5) FILTER (WHERE rn <= 4) AS ref, count(*) AS nc FROM site_rank GROUP BY entity")
cte("site_adm", """
SELECT r.*, ref, r.rn <= 8 AND dist <= 3 * ref AS ok, count(*) FILTER (WHERE r.rn <= 8 AND dist <= 3 * ref) OVER (PARTITION BY r.entity) AS nok FROM site_rank r JOIN site_ref USING (entity)
""")
cte("site_used", """
SELECT * FROM site_adm WHERE nc >= 4 AND CASE WHEN nc <= 4 THEN true WHEN ref <= 0 THEN rn <= 8 WHEN nok >= 4 THEN ok ELSE rn <= 4 END
""")
cte("site_odd", """
SELECT entity, observed, quantile_cont(v, 0.5) AS expected, count(*) AS n_peers, greatest(1.4826 * mad(v), 0.1 * abs(quantile_cont(v, 0.5))) AS disp FROM site_used GROUP BY entity, observed
""")


@query("robust_profiles", "SELECT entity, round(z1, 6) AS z_customers, round(z2, 6) AS z_energy_kwh, round(z3, 6) AS z_kva FROM site_z")
def _(spark, d):
    z = entities.robust_scale(sites(spark, d), ["customers", "energy_kwh", "kva"])
    return rounded(z.select("entity", "z_customers", "z_energy_kwh", "z_kva"), z_customers=6, z_energy_kwh=6, z_kva=6)


@query("entities_against_peers", """
SELECT entity, round(observed, 6) AS observed, round(expected, 6) AS expected, round((observed - expected) / disp, 5) AS robust_z, CAST(n_peers AS INTEGER) AS n_peers,
  CASE WHEN abs((observed - expected) / disp) >= 4.5 THEN 'ALTA' ELSE 'MEDIA' END AS severity FROM site_odd WHERE disp > 0 AND abs((observed - expected) / disp) >= 1.5
""")
def _(spark, d):
    out = entities.compare_with_peers(
        sites(spark, d), entity="entity", metric="ntl_pct", profile=["customers", "energy_kwh", "kva", "ntl_pct"], block=["unit"], z_min=1.5)
    return rounded(out.select("entity", "observed", "expected", "robust_z", "n_peers", "severity"), observed=6, expected=6, robust_z=5)


@query("nearest_peers", """
WITH r AS (SELECT a.entity, b.entity AS peer, sqrt(pow(a.z1 - b.z1, 2) + pow(a.z2 - b.z2, 2) + pow(a.z3 - b.z3, 2)) AS dist FROM site_z a JOIN site_z b ON a.entity <> b.entity)
SELECT entity, peer, round(dist, 6) AS distance, CAST(rn AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY dist, peer) AS rn FROM r) WHERE rn <= 5
""")
def _(spark, d):
    z = stage(entities.robust_scale(sites(spark, d), ["customers", "energy_kwh", "kva"]), "z").withColumns(
        {"blk": F.lit("*"), "asks": F.lit(True)})
    out = entities.nearest_peers(z, ["z_customers", "z_energy_kwh", "z_kva"], 5, entity="entity", block="blk")
    return rounded(out.select("entity", "peer", "distance", F.col("position").cast("int").alias("position")), distance=6)


@query("most_similar_entities", """
WITH t AS (SELECT z1, z2, z3 FROM site_z WHERE entity = 'T000003')
SELECT entity, round(sqrt(pow(s.z1 - t.z1, 2) + pow(s.z2 - t.z2, 2) + pow(s.z3 - t.z3, 2)), 6) AS distance FROM site_z s, t ORDER BY distance, entity LIMIT 9
""")
def _(spark, d):
    out = entities.most_similar(sites(spark, d), "T000003", entity="entity", profile=["customers", "energy_kwh", "kva"])
    return rounded(out.select("entity", "distance"), distance=6)


# --- validation --------------------------------------------------------------

def cases(spark, d) -> DataFrame:
    l = table(spark, d, "labels")
    k = F.col("doc_id")
    return l.where(F.col("toxic") == 1).select(
        (k - k % 2).alias("account"), F.when(k % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 200).cast("int"))).alias("date"),
        (k * 1.5).alias("kwh"), F.concat(F.lit("T"), (k % 3).cast("string")).alias("kind"))


cte("cases", """
SELECT doc_id - doc_id % 2 AS account, CASE WHEN doc_id % 5 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 200 AS INTEGER) END AS date, doc_id * 1.5::DOUBLE AS kwh, 'T' || (doc_id % 3) AS kind
FROM labels WHERE toxic = 1
""")


@query("confirmed_cases", """
WITH k AS (SELECT * FROM cases WHERE date IS NULL OR date < DATE '2024-06-01')
SELECT CAST(account AS VARCHAR) AS account, date, kwh, kind, cases FROM (SELECT *, count(*) OVER (PARTITION BY account) AS cases,
  row_number() OVER (PARTITION BY account ORDER BY coalesce(date, DATE '0001-01-01') DESC, kwh DESC, kind DESC) AS rn FROM k) WHERE rn = 1
""")
def _(spark, d):
    return validation.load_confirmed(cases(spark, d), "2024-06-01")


def doc_positions(spark, d) -> DataFrame:
    r = table(spark, d, "documents").select(F.col("doc_id").alias("account"), F.col("n_chars").cast("double").alias("score"))
    confirmed = table(spark, d, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("account"))
    return validation.labelled_positions(r, confirmed)


cte("doc_pos", """
SELECT doc_id AS account, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS hit, count(*) OVER () AS n FROM documents
""")


@query("top_k_metrics", """
WITH k(k_pct) AS (VALUES (1.0::DOUBLE), (5.0), (10.0), (20.0)), p AS (SELECT count(*) FILTER (WHERE hit) AS p FROM doc_pos),
t AS (SELECT k_pct, CAST(greatest(1, round_even(n * k_pct / 100, 0)) AS BIGINT) AS top, n, p FROM k, p, (SELECT count(*) AS n FROM doc_pos)),
f AS (SELECT t.*, (SELECT count(*) FROM doc_pos WHERE hit AND pos <= top) AS found FROM t)
SELECT k_pct, top, found, round(found::DOUBLE / top, 9) AS precision, round(found::DOUBLE / p, 9) AS recall, round(found::DOUBLE / top / (p::DOUBLE / n), 6) AS lift FROM f
""")
def _(spark, d):
    return rounded(validation.top_k_metrics(doc_positions(spark, d)), precision=9, recall=9, lift=6)


@query("rank_quality", """
WITH s AS (SELECT max(n) AS n, count(*) FILTER (WHERE hit) AS p, sum(pos) FILTER (WHERE hit) AS rs, quantile_cont(pos, 0.5) FILTER (WHERE hit) AS med FROM doc_pos)
SELECT n, p AS confirmed, round(p::DOUBLE / n, 9) AS prevalence, round(med / n * 100, 6) AS median_position_pct,
  round((p * (n - p) + p * (p + 1) / 2 - rs)::DOUBLE / (p * (n - p)), 9) AS auc FROM s
""")
def _(spark, d):
    return rounded(validation.rank_quality(doc_positions(spark, d)), prevalence=9, median_position_pct=6, auc=9)


@query("gain_by_decile", """
SELECT CAST(greatest(1, ceil(10.0::DOUBLE * (pos - 1) / (n - 1))) AS INTEGER) AS decile, count(*) AS customers, count(*) FILTER (WHERE hit) AS confirmed,
  round(count(*) FILTER (WHERE hit) * 100.0::DOUBLE / count(*), 2) AS hit_rate_pct FROM doc_pos GROUP BY 1
""")
def _(spark, d):
    return validation.gain_by_decile(doc_positions(spark, d))


def debtors(spark, d) -> DataFrame:
    return table(spark, d, "customer").where(F.col("c_acctbal") < -500).select(F.col("c_custkey").alias("account"))


@query("signal_calibration", """
WITH s AS (SELECT l.*, account IN (SELECT c_custkey FROM customer WHERE c_acctbal < -500) AS hit FROM signal_long l),
g AS (SELECT signal, count(*) FILTER (WHERE hit) AS p, count(*) FILTER (WHERE NOT hit) AS q, count(*) FILTER (WHERE hit AND v > 0) AS a, count(*) FILTER (WHERE NOT hit AND v > 0) AS b FROM s GROUP BY 1),
l AS (SELECT *, ((a + 0.5) / (p + 1.0::DOUBLE)) / ((b + 0.5) / (q + 1.0::DOUBLE)) AS lf FROM g)
SELECT signal, round(a * 100.0::DOUBLE / p, 2) AS active_confirmed_pct, round(b * 100.0::DOUBLE / q, 2) AS active_rest_pct, a AS activations, round(lf, 2) AS lift,
  CASE WHEN lf > 2 THEN 'Aumentar peso' WHEN lf > 1.2 THEN 'Mantener' ELSE 'Revisar umbral o desactivar (no discrimina)' END AS recommendation FROM l
""")
def _(spark, d):
    return validation.calibrate_signals(signal_table(spark, d), debtors(spark, d))


PU_SIGNALS = ["S1", "S3", "S4", "S5", "S7", "S8", "S9"]


def _pu_ctes(rounds: int = 25) -> None:
    """The model's rounds written out: one row of weights after each."""
    cuts = validation.PU_CUTS
    level = lambda c: f"CASE WHEN r.hi_{c} > r.lo_{c} THEN " + " + ".join(f"CASE WHEN ({c} - r.lo_{c}) / (r.hi_{c} - r.lo_{c}) > {k} THEN 1 ELSE 0 END" for k in cuts) + " ELSE 0 END"
    cte("pusignals", "SELECT account, " + ", ".join(f"round({c}, 9) AS {c}" for c in PU_SIGNALS) + " FROM signals")
    cte("pudata", f"""
SELECT account, {", ".join(f"{level(c)} AS f{i}" for i, c in enumerate(PU_SIGNALS))}, CAST(account IN (SELECT c_custkey FROM customer WHERE c_acctbal < -500) AS INTEGER) AS label,
  CAST('0x' || substr(md5(account || '|20260807'), 1, 8) AS BIGINT) % 10 < 3 AS held_out
FROM pusignals, (SELECT {", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in PU_SIGNALS)} FROM pusignals) r
""", kept=True)
    levels = [f"f{i}" for i in range(len(PU_SIGNALS))]
    cte("pupattern", f"SELECT {', '.join(levels)}, label, held_out, count(*) AS n FROM pudata GROUP BY ALL", kept=True)
    units = [("bias", "1.0")] + [(f"{f}_{j}", f"CASE WHEN {f} = {j} THEN 1.0 ELSE 0.0 END") for f in levels for j in range(1, len(cuts) + 1)]
    chance = "1 / (1 + exp(-(" + " + ".join(f"w_{name} * {x}" for name, x in units) + ")))"
    bias = "ln((sum(n) FILTER (label = 1) + 1.0::DOUBLE) / (sum(n) FILTER (label = 0) + 1.0::DOUBLE))"
    cte("puw_0", f"SELECT {bias} AS w_bias, " + ", ".join(f"0.0::DOUBLE AS w_{name}" for name, _ in units[1:]) + " FROM pupattern WHERE NOT held_out", kept=True)
    for k in range(1, rounds + 1):
        new = ", ".join(
            f"any_value(w_{name}) - (sum(n * (p - label) * {x}) + any_value(w_{name})) / (sum(n * p * (1 - p) * {x}) + 1) / {len(PU_SIGNALS) + 1} AS w_{name}" for name, x in units)
        cte(f"puw_{k}", f"SELECT {new} FROM (SELECT *, {chance} AS p FROM pupattern, puw_{k - 1} WHERE NOT held_out)", kept=True)
    cte("puscore", f"SELECT *, {chance} AS p FROM pupattern, puw_{rounds}", kept=True)


_pu_ctes()


@query("pu_scores", """
WITH c AS (SELECT least(greatest(coalesce(sum(n * p) / sum(n), 1), 0.001), 1) AS propensity FROM puscore WHERE held_out AND label = 1),
q AS (SELECT sum(n) FILTER (label = 1) AS positives FROM pupattern)
SELECT d.account, round(CASE WHEN coalesce(positives, 0) < 10 THEN 0 ELSE least(greatest(s.p / propensity, 0), 1) END, 6) AS pu_score, round(CASE WHEN coalesce(positives, 0) < 10 THEN 1 ELSE propensity END, 6) AS propensity
FROM pudata d JOIN (SELECT DISTINCT """ + ", ".join(f"f{i}" for i in range(len(PU_SIGNALS))) + """, p FROM puscore) s USING (""" + ", ".join(f"f{i}" for i in range(len(PU_SIGNALS))) + """), c, q
""")
def _(spark, d):
    return rounded(validation.pu_learning(signal_table(spark, d), debtors(spark, d), PU_SIGNALS), pu_score=6, propensity=6)


# --- inspections -------------------------------------------------------------

def field_rows(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    t = F.col("event_type")
    return e.select(
        F.col("user_id").alias("account"),
        F.when(F.col("value") > 5, "true").otherwise("no").alias("inspected"),
        F.when(t == "error", "conexion_directa").when(t == "click", "SIN_NOVEDAD").when(t == "view", " PREDIO_CERRADO ")
        .when(t == "purchase", "MEDIDOR_MANIPULADO").otherwise("HALLAZGO_NUEVO").alias("finding"),
        F.to_date("ts").cast("string").alias("inspected_on"),
        F.concat(F.lit("OT"), (F.col("user_id") % 10).cast("string")).alias("work_order"),
        F.concat(F.lit("tec"), (F.col("event_id") % 3).cast("string")).alias("technician"),
        F.col("value").cast("string").alias("meter_reading"), "event_id")


cte("inspected", """
SELECT CAST(user_id AS VARCHAR) AS account, CASE event_type WHEN 'error' THEN 'CONEXION_DIRECTA' WHEN 'click' THEN 'SIN_NOVEDAD' WHEN 'view' THEN 'PREDIO_CERRADO'
    WHEN 'purchase' THEN 'MEDIDOR_MANIPULADO' ELSE 'HALLAZGO_NUEVO' END AS finding,
  CASE event_type WHEN 'error' THEN 'CONFIRMADO' WHEN 'purchase' THEN 'CONFIRMADO' WHEN 'click' THEN 'DESCARTADO' ELSE 'NO_CONCLUYENTE' END AS verdict,
  CAST(ts AS DATE) AS inspected_on, 'OT' || (user_id % 10) AS work_order, 'tec' || (event_id % 3) AS technician, value AS meter_reading, event_id
FROM events WHERE value > 5
""")
cte("registry_rows", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account, work_order, inspected_on ORDER BY event_id DESC) AS rn FROM inspected) WHERE rn = 1
""")


@query("inspection_extract", "SELECT account, finding, verdict, inspected_on, work_order, technician, meter_reading FROM inspected")
def _(spark, d):
    return inspections.extract_inspections(field_rows(spark, d))


def registry(spark, d) -> DataFrame:
    """Registry after two campaigns, the second of which repeats part of the first."""
    rows = field_rows(spark, d)
    src = rows.withColumn("technician", F.concat_ws("#", "technician", F.lpad(F.col("event_id").cast("string"), 12, "0")))
    ext = inspections.extract_inspections(src).withColumn("loaded_at", F.substring_index("technician", "#", -1).cast("bigint")).withColumn(
        "technician", F.substring_index("technician", "#", 1))
    first = inspections.upsert_registry(None, ext.where(F.col("loaded_at") % 3 != 0))
    return inspections.upsert_registry(first, ext)


@query("inspection_registry", "SELECT account, work_order, inspected_on, finding, verdict, technician, meter_reading FROM registry_rows")
def _(spark, d):
    return registry(spark, d).select("account", "work_order", "inspected_on", "finding", "verdict", "technician", "meter_reading")


@query("confirmed_base", """
SELECT account, date, kind, origin FROM (SELECT *, row_number() OVER (PARTITION BY account, date ORDER BY o, kind) AS rn FROM (
  SELECT account, inspected_on AS date, finding AS kind, 'CAMPO' AS origin, 1 AS o FROM registry_rows WHERE verdict = 'CONFIRMADO'
  UNION ALL SELECT CAST(account AS VARCHAR), date, kind, 'HISTORICO', 0 FROM cases)) WHERE rn = 1
""")
def _(spark, d):
    return inspections.confirmed_base(registry(spark, d), cases(spark, d))


@query("verified_negatives", "SELECT DISTINCT account FROM registry_rows WHERE verdict = 'DESCARTADO'")
def _(spark, d):
    return inspections.verified_negatives(registry(spark, d))


@query("inconclusive_visits", "SELECT account, work_order, inspected_on, finding FROM registry_rows WHERE verdict = 'NO_CONCLUYENTE'")
def _(spark, d):
    return inspections.inconclusive(registry(spark, d)).select("account", "work_order", "inspected_on", "finding")


@query("campaign_summary", """
SELECT *, round(100.0::DOUBLE * confirmed / (confirmed + discarded), 1) AS precision_pct, round(100.0::DOUBLE * (confirmed + discarded) / inspections, 1) AS coverage_pct FROM (
  SELECT count(*) AS inspections, count(*) FILTER (WHERE verdict = 'CONFIRMADO') AS confirmed, count(*) FILTER (WHERE verdict = 'DESCARTADO') AS discarded,
    count(*) FILTER (WHERE verdict = 'NO_CONCLUYENTE') AS inconclusive, count(*) FILTER (WHERE verdict = 'PROBLEMA_DATOS') AS data_problems FROM registry_rows)
""")
def _(spark, d):
    return inspections.campaign_summary(registry(spark, d))


@query("yield_per_order", """
SELECT work_order, count(*) AS visits, count(*) FILTER (WHERE verdict IN ('CONFIRMADO', 'DESCARTADO')) AS verified, count(*) FILTER (WHERE verdict = 'CONFIRMADO') AS confirmed,
  round(100.0::DOUBLE * count(*) FILTER (WHERE verdict = 'CONFIRMADO') / nullif(count(*) FILTER (WHERE verdict IN ('CONFIRMADO', 'DESCARTADO')), 0), 1) AS precision_pct
FROM registry_rows GROUP BY 1
""")
def _(spark, d):
    return inspections.yield_per_order(registry(spark, d))


@query("field_lift", """
WITH r AS (SELECT account, rank, (SELECT greatest(1, floor(count(*) * 10 / 100)) FROM ranking) AS cut FROM ranking),
v AS (SELECT CASE WHEN verdict = 'CONFIRMADO' THEN 1.0::DOUBLE ELSE 0.0 END AS theft, coalesce(rank <= cut, false) AS top FROM registry_rows g LEFT JOIN r ON CAST(r.account AS VARCHAR) = g.account
  WHERE verdict IN ('CONFIRMADO', 'DESCARTADO'))
SELECT count(*) AS verified, count(*) FILTER (WHERE top) AS in_top, round(100 * coalesce(avg(theft) FILTER (WHERE top), 0), 6) AS precision_top_pct,
  round(100 * coalesce(avg(theft) FILTER (WHERE NOT top), 0), 6) AS precision_rest_pct, round(coalesce(avg(theft) FILTER (WHERE top), 0) / avg(theft), 6) AS field_lift FROM v
""")
def _(spark, d):
    out = inspections.field_lift(registry(spark, d), ranking(spark, d).select("account", "rank"))
    return rounded(out, precision_top_pct=6, precision_rest_pct=6, field_lift=6)
