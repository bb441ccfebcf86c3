"""Balances, organisation roll-up, coverage, history and transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.operators import balance, coverage, history, transfers
from wattledger.registry.core import cte, query
from wattledger.registry.customers import rounded
from wattledger.registry.inputs import code, head_energy, hierarchy, table
from wattledger.staging import stage


def orders_by_account(spark, d, *extra) -> DataFrame:
    """Whole kWh of each account (optionally by further keys), billed and total.

    Aggregated before the join with ``customer``, so a busy account is one row.
    """
    kwh = F.floor(F.col("o_totalprice") / 100).cast("double")
    billed = (F.col("o_orderstatus") != "P") | (F.col("o_orderpriority") <= "3-MEDIUM")
    return table(spark, d, "orders").groupBy("o_custkey", *extra).agg(
        F.sum(kwh).alias("total"), F.sum(F.when(billed, kwh).otherwise(F.lit(0.0))).alias("billed"))


def feeder_orders(spark, d, *extra) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    names = ["year" for _ in extra]
    a = orders_by_account(spark, d, *extra)
    return a.join(c, a.o_custkey == c.c_custkey).groupBy("nation", *names).agg(
        F.sum("total").alias("total"), F.sum("billed").alias("billed0"), F.count_distinct("o_custkey").alias("traced"))


cte("feeder_orders", """
SELECT c_nationkey AS nation, sum(floor(o_totalprice / 100)) AS total,
  sum(CASE WHEN o_orderstatus <> 'P' OR o_orderpriority <= '3-MEDIUM' THEN floor(o_totalprice / 100) ELSE 0 END) AS billed0,
  count(DISTINCT o_custkey) AS traced
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")


def balance_input(spark, d) -> DataFrame:
    n = F.col("nation")
    declared = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("__d"))
    return feeder_orders(spark, d).join(declared, "nation").select(
        code("F", n).alias("feeder"),
        F.when(n % 7 != 3, F.col("total")).alias("input_kwh"),
        (F.col("billed0") * F.when(n % 11 == 5, 1.3).otherwise(1.0)).alias("billed_kwh"),
        (F.col("total") * F.when(n % 5 == 0, 0.25).otherwise(0.06)).alias("technical_kwh"),
        F.col("traced").alias("customers_traced"),
        F.floor(F.col("__d") * F.when(n % 6 == 1, 1.5).otherwise(1.0)).alias("customers_declared"),
        (60 + n * 2).cast("double").alias("energy_coverage_pct"),
        (F.col("total") * 0.01).alias("lighting_kwh"),
    )


cte("balance_in", """
SELECT 'F' || lpad(CAST(f.nation AS VARCHAR), 3, '0') AS feeder, CASE WHEN f.nation % 7 <> 3 THEN total END AS input_kwh,
  billed0 * CASE WHEN f.nation % 11 = 5 THEN 1.3 ELSE 1.0 END::DOUBLE AS billed_kwh,
  total * CASE WHEN f.nation % 5 = 0 THEN 0.25 ELSE 0.06 END::DOUBLE AS technical_kwh, traced AS customers_traced,
  floor(n * CASE WHEN f.nation % 6 = 1 THEN 1.5 ELSE 1.0 END) AS customers_declared,
  CAST(60 + f.nation * 2 AS DOUBLE) AS energy_coverage_pct, total * 0.01::DOUBLE AS lighting_kwh
FROM feeder_orders f JOIN (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1) c ON c.nation = f.nation
""")
cte("feeder_balance", """
SELECT *, CASE WHEN input_kwh > 0 THEN ntl_kwh / input_kwh * 100 ELSE 0 END AS ntl_pct,
  CASE WHEN input_kwh > 0 THEN loss_total_kwh / input_kwh * 100 ELSE 0 END AS loss_pct,
  CASE WHEN input_kwh > 0 THEN technical_kwh / input_kwh * 100 ELSE 0 END AS technical_pct
FROM (SELECT *, loss_total_kwh - technical_kwh AS ntl_kwh FROM (
  SELECT *, input_kwh - billed_kwh - lighting_kwh - own_use_kwh AS loss_total_kwh FROM (
    SELECT feeder, coalesce(input_kwh, (billed_kwh + lighting_kwh + billed_kwh * 0.001) / 0.88) AS input_kwh,
      CASE WHEN input_kwh IS NULL THEN 'INDICATIVO' ELSE 'MEDIDO' END AS balance_type, billed_kwh, technical_kwh, lighting_kwh,
      billed_kwh * 0.001 AS own_use_kwh, customers_traced, customers_declared, energy_coverage_pct FROM balance_in)))
""")


def balances(spark, d) -> DataFrame:
    return balance.feeder_balance(balance_input(spark, d), loss_rate=0.12)


_B = ["input_kwh", "billed_kwh", "lighting_kwh", "own_use_kwh", "loss_total_kwh", "ntl_kwh", "ntl_pct", "loss_pct", "technical_pct"]


@query("feeder_balance", "SELECT feeder, balance_type, " + ", ".join(f"round({c}, 4) AS {c}" for c in _B) + " FROM feeder_balance")
def _(spark, d):
    return rounded(balances(spark, d).select("feeder", "balance_type", *_B), **{c: 4 for c in _B})


cte("feeder_controls", """
SELECT feeder, 'C01' AS code, ntl_kwh < 0 AS triggered, ntl_kwh AS observed, 0.0 AS threshold FROM feeder_balance
UNION ALL SELECT feeder, 'C02', ntl_pct > 60, ntl_pct, 60 FROM feeder_balance
UNION ALL SELECT feeder, 'C03', billed_kwh > input_kwh, billed_kwh, input_kwh FROM feeder_balance
UNION ALL SELECT feeder, 'C04', technical_pct > 20, technical_pct, 20 FROM feeder_balance
UNION ALL SELECT feeder, 'C05', abs(customers_traced - customers_declared) / customers_declared * 100 > 10, abs(customers_traced - customers_declared) / customers_declared * 100, 10 FROM feeder_balance
UNION ALL SELECT feeder, 'C06', energy_coverage_pct < 70, energy_coverage_pct, 70 FROM feeder_balance
""")


@query("balance_controls", "SELECT feeder, code, triggered, round(observed, 4) AS observed, round(threshold, 4) AS threshold FROM feeder_controls")
def _(spark, d):
    c = balance.with_controls(balances(spark, d)).select("feeder", F.inline("controls"))
    return rounded(c, observed=4, threshold=4)


@query("head_energy_by_feeder", "SELECT feeder, sum(kwh) AS kwh, count(*) AS periods FROM head_energy GROUP BY feeder")
def _(spark, d):
    from wattledger.sources.catalogues import head_totals

    return head_totals(head_energy(spark, d))


@query("hierarchy_load", """
SELECT feeder, substation, unit FROM (
  SELECT 'F' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS feeder, 'S' || CAST(s_suppkey % 7 AS VARCHAR) AS substation,
    'U' || CAST(s_suppkey % 3 AS VARCHAR) AS unit, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) WHERE rn = 1
""")
def _(spark, d):
    s = table(spark, d, "supplier")
    raw = s.select(
        F.concat(F.lit(" "), code("F", F.col("s_nationkey"))).alias("feeder"),
        F.concat(F.lit("S"), (F.col("s_suppkey") % 7).cast("string")).alias("substation"),
        F.concat(F.lit("U"), (F.col("s_suppkey") % 3).cast("string"), F.lit(" ")).alias("unit"), "s_suppkey")
    return balance.load_hierarchy(raw, F.col("s_suppkey"))


@query("hierarchy_inferred", """
SELECT DISTINCT feeder, 'SIN_SUBESTACION' AS substation, CASE WHEN feeder LIKE '%-%' THEN split_part(feeder, '-', 1) ELSE 'SIN_UN' END AS unit
FROM (SELECT CASE WHEN c_nationkey % 4 = 0 THEN 'X' || c_nationkey ELSE 'U' || (c_nationkey % 5) || '-' || c_nationkey END AS feeder FROM customer)
""")
def _(spark, d):
    n = F.col("c_nationkey")
    name = F.when(n % 4 == 0, F.concat(F.lit("X"), n.cast("string"))).otherwise(
        F.concat(F.lit("U"), (n % 5).cast("string"), F.lit("-"), n.cast("string")))
    return balance.inferred_hierarchy(table(spark, d, "customer").select(name.alias("feeder")))


cte("rolled", """
SELECT CASE WHEN grouping(substation) = 0 THEN 'SUBESTACION' ELSE 'UNIDAD_NEGOCIO' END AS level, unit, substation,
  sum(input_kwh) AS input_kwh, sum(billed_kwh) AS billed_kwh, sum(loss_total_kwh) AS loss_total_kwh, sum(technical_kwh) AS technical_kwh, sum(ntl_kwh) AS ntl_kwh,
  count(DISTINCT feeder) AS feeders, CASE WHEN bool_or(balance_type = 'INDICATIVO') THEN 'INDICATIVO' ELSE 'MEDIDO' END AS balance_type,
  count(DISTINCT CASE WHEN balance_type <> 'MEDIDO' THEN feeder END) AS feeders_not_measured
FROM (SELECT b.*, coalesce(h.substation, 'SIN_SUBESTACION') AS substation, coalesce(h.unit, 'SIN_UN') AS unit
  FROM feeder_balance b LEFT JOIN (SELECT * FROM hierarchy WHERE feeder <> 'F004') h USING (feeder))
GROUP BY GROUPING SETS ((unit, substation), (unit))
""")


def rolled(spark, d, b: DataFrame | None = None) -> DataFrame:
    h = hierarchy(spark, d).where(F.col("feeder") != "F004")
    return balance.roll_up(b or balances(spark, d), h)


@query("organisation_rollup", """
SELECT level, unit, substation, round(input_kwh, 2) AS input_kwh, round(billed_kwh, 2) AS billed_kwh, round(ntl_kwh, 1) AS ntl_kwh, feeders, balance_type, feeders_not_measured,
  round(ntl_kwh / input_kwh * 100, 2) AS ntl_pct, round(loss_total_kwh / input_kwh * 100, 2) AS loss_pct FROM rolled
""")
def _(spark, d):
    r = rolled(spark, d).select("level", "unit", "substation", "input_kwh", "billed_kwh", "ntl_kwh", "feeders", "balance_type",
                                "feeders_not_measured", "ntl_pct", "loss_pct")
    return rounded(r, input_kwh=2, billed_kwh=2, ntl_kwh=1)


# --- coverage ---------------------------------------------------------------

def loads(spark, d) -> DataFrame:
    of = lambda df, col, kind: df.select(F.lit(kind).alias("input"), code("F", F.col(col)).alias("feeder")).distinct()
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return (
        of(c.where(F.col("c_mktsegment") == "HOUSEHOLD"), "c_nationkey", "PADRON_COMERCIAL")
        .unionByName(of(s.where(F.col("s_acctbal") > 4000), "s_nationkey", "RED"))
        .unionByName(of(s.where(F.col("s_acctbal") > 9990), "s_nationkey", "CABECERA"))
    )


cte("loads", """
SELECT DISTINCT 'PADRON_COMERCIAL' AS input, 'F' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS feeder FROM customer WHERE c_mktsegment = 'HOUSEHOLD'
UNION ALL SELECT DISTINCT 'RED', 'F' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') FROM supplier WHERE s_acctbal > 4000
UNION ALL SELECT DISTINCT 'CABECERA', 'F' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') FROM supplier WHERE s_acctbal > 9990
""")
cte("universe", "SELECT DISTINCT feeder FROM hierarchy WHERE feeder <= 'F019'")


def universe(spark, d) -> DataFrame:
    return hierarchy(spark, d).where(F.col("feeder") <= "F019").select("feeder")


@query("loads_outside_universe", "SELECT input, feeder, feeder NOT IN (SELECT feeder FROM universe) AS outside_universe FROM loads")
def _(spark, d):
    return coverage.mark_unknown(loads(spark, d), universe(spark, d)).select("input", "feeder", "outside_universe")


@query("load_coverage", """
SELECT k.input, count(l.feeder) AS loaded, (SELECT count(*) FROM universe) AS expected,
  round(count(l.feeder) * 100.0::DOUBLE / (SELECT count(*) FROM universe), 1) AS coverage_pct,
  CASE WHEN count(l.feeder) = 0 THEN 'VACIA' WHEN count(l.feeder) >= (SELECT count(*) FROM universe) THEN 'COMPLETA' ELSE 'PARCIAL' END AS state,
  (SELECT count(*) FROM universe) - count(l.feeder) AS missing
FROM (VALUES ('PADRON_COMERCIAL'), ('RED'), ('CABECERA')) k(input)
LEFT JOIN (SELECT * FROM loads WHERE feeder IN (SELECT feeder FROM universe)) l USING (input) GROUP BY k.input
""")
def _(spark, d):
    return coverage.coverage(loads(spark, d), universe(spark, d))


@query("loads_pending", """
SELECT feeder, input FROM universe CROSS JOIN (VALUES ('PADRON_COMERCIAL'), ('RED'), ('CABECERA')) k(input)
EXCEPT SELECT feeder, input FROM loads
""")
def _(spark, d):
    return coverage.pending(loads(spark, d), universe(spark, d))


@query("ready_for_measured_balance", """
SELECT feeder FROM loads WHERE input = 'PADRON_COMERCIAL' INTERSECT SELECT feeder FROM loads WHERE input = 'RED'
INTERSECT SELECT feeder FROM loads WHERE input = 'CABECERA'
""")
def _(spark, d):
    return coverage.ready_for_measured(loads(spark, d))


@query("partial_balance", """
WITH r AS (SELECT 100.0::DOUBLE * count(*) / (SELECT count(*) FROM universe) AS pct FROM universe u
  WHERE (SELECT count(*) FROM loads l WHERE l.feeder = u.feeder) = 3)
SELECT level, unit, substation, round(pct, 1) AS coverage_pct, CASE WHEN pct < 99.9 THEN 'PARCIAL' ELSE balance_type END AS balance_type FROM rolled, r
""")
def _(spark, d):
    m = coverage.mark_partial(rolled(spark, d), loads(spark, d), universe(spark, d))
    return m.select("level", "unit", "substation", "coverage_pct", "balance_type")


# --- history ----------------------------------------------------------------

def snapshots(spark, d) -> DataFrame:
    y = F.year("o_orderdate").alias("year")
    g = feeder_orders(spark, d, y)
    ntl = F.col("total") - F.col("billed0") - F.col("total") * 0.05
    return g.select(
        F.col("year").cast("string").alias("period"), F.lit("ALIMENTADOR").alias("level"), code("F", F.col("nation")).alias("entity"),
        F.col("total").alias("input_kwh"), F.col("billed0").alias("billed_kwh"), ntl.alias("ntl_kwh"),
        F.round(ntl / F.col("total") * 100, 2).alias("ntl_pct"), F.col("traced").alias("customers"),
        F.when(F.col("nation") % 7 == 3, "INDICATIVO").otherwise("MEDIDO").alias("balance_type"),
        (80 + F.col("nation")).cast("double").alias("coverage_pct"),
        F.when(F.col("year") < 1999, "a1").otherwise("b2").alias("config_hash"))


cte("snapshots", """
SELECT CAST(year(o_orderdate) AS VARCHAR) AS period, 'ALIMENTADOR' AS level, 'F' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS entity,
  sum(floor(o_totalprice / 100)) AS input_kwh,
  sum(CASE WHEN o_orderstatus <> 'P' OR o_orderpriority <= '3-MEDIUM' THEN floor(o_totalprice / 100) ELSE 0 END) AS billed_kwh,
  sum(floor(o_totalprice / 100)) - sum(CASE WHEN o_orderstatus <> 'P' OR o_orderpriority <= '3-MEDIUM' THEN floor(o_totalprice / 100) ELSE 0 END) - sum(floor(o_totalprice / 100)) * 0.05 AS ntl_kwh,
  count(DISTINCT o_custkey) AS customers, CASE WHEN c_nationkey % 7 = 3 THEN 'INDICATIVO' ELSE 'MEDIDO' END AS balance_type,
  CAST(80 + c_nationkey AS DOUBLE) AS coverage_pct, CASE WHEN year(o_orderdate) < 1999 THEN 'a1' ELSE 'b2' END AS config_hash
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY year(o_orderdate), c_nationkey
""")


@query("snapshot_upsert", """
SELECT period, level, entity, customers + CASE WHEN period = '1999' AND entity < 'F010' THEN 1000 ELSE 0 END AS customers, input_kwh FROM snapshots
""")
def _(spark, d):
    h = stage(snapshots(spark, d), "history")
    fixed = h.where((F.col("period") == "1999") & (F.col("entity") < "F010")).withColumn("customers", F.col("customers") + 1000)
    return history.upsert(h, fixed).select("period", "level", "entity", "customers", "input_kwh")


@query("entity_history", """
SELECT period, round(ntl_kwh / input_kwh * 100, 2) AS ntl_pct, balance_type, coverage_pct, config_hash FROM snapshots WHERE entity = 'F003'
""")
def _(spark, d):
    return history.entity_series(snapshots(spark, d), "F003", "ALIMENTADOR")


@query("period_comparison", """
SELECT entity, a.p AS ntl_pct_a, b.p AS ntl_pct_b, round(b.p - a.p, 2) AS delta_ntl_pct, round_even(b.ntl_kwh - a.ntl_kwh, 0) AS delta_ntl_kwh,
  CASE WHEN round(b.p - a.p, 2) < -0.5 THEN 'MEJORA' WHEN round(b.p - a.p, 2) > 0.5 THEN 'EMPEORA' ELSE 'ESTABLE' END AS trend,
  a.config_hash = b.config_hash AS comparable, a.balance_type AS balance_type_a, b.balance_type AS balance_type_b
FROM (SELECT *, round(ntl_kwh / input_kwh * 100, 2) AS p FROM snapshots WHERE period = '1998') a
JOIN (SELECT *, round(ntl_kwh / input_kwh * 100, 2) AS p FROM snapshots WHERE period = '1999') b USING (entity)
""")
def _(spark, d):
    return history.compare_periods(snapshots(spark, d), "1998", "1999", "ALIMENTADOR")


@query("history_warnings", """
SELECT count(DISTINCT config_hash) AS settings, count(*) FILTER (WHERE balance_type IN ('INDICATIVO', 'PARCIAL')) AS not_measured,
  count(*) FILTER (WHERE coverage_pct < 90) AS low_coverage, count(DISTINCT config_hash) > 1 AS mixed_settings FROM snapshots
""")
def _(spark, d):
    return history.warnings(snapshots(spark, d))


# --- transfers --------------------------------------------------------------

cte("tr_axis", "SELECT period, row_number() OVER (ORDER BY period) - 1 AS i FROM (SELECT DISTINCT period FROM head_energy)")
cte("tr_lag", """
SELECT h.feeder, period, i, kwh, CASE WHEN lag(i) OVER w = i - 1 THEN lag(kwh) OVER w END AS prev
FROM head_energy h JOIN tr_axis USING (period) WINDOW w AS (PARTITION BY feeder ORDER BY i)
""")
cte("tr_common", "SELECT i, quantile_cont(kwh / nullif(prev, 0) - 1, 0.5) AS common FROM tr_lag GROUP BY i")
cte("tr_res", "SELECT feeder, period, i, kwh, prev, (kwh / nullif(prev, 0) - 1 - common) * prev AS delta FROM tr_lag JOIN tr_common USING (i)")
cte("tr_noise", "SELECT feeder, CASE WHEN count(delta) < 3 THEN 0 ELSE 1.4826 * mad(delta) END AS noise FROM tr_res GROUP BY feeder")
cte("tr_move", """
SELECT r.*, n.noise, CASE WHEN lead(i) OVER w = i + 1 THEN lead(delta) OVER w END AS nxt, abs(delta) AS mag, abs(delta) / prev * 100 AS pct
FROM tr_res r JOIN tr_noise n USING (feeder) WINDOW w AS (PARTITION BY feeder ORDER BY i)
""")
cte("tr_pair", """
SELECT a.feeder AS fa, b.feeder AS fb, a.period, a.i, a.delta AS da, b.delta AS db, least(a.mag, b.mag) / greatest(a.mag, b.mag) AS sym,
  (a.mag / pow(greatest(a.noise, 1), 2) + b.mag / pow(greatest(b.noise, 1), 2)) / (1 / pow(greatest(a.noise, 1), 2) + 1 / pow(greatest(b.noise, 1), 2)) AS magnitude,
  greatest(a.pct, b.pct) AS peak, a.mag AS ma, b.mag AS mb, greatest(a.noise, b.noise) AS noise,
  coalesce(a.nxt > 0 AND a.nxt > 0.7 * a.mag AND b.nxt < 0 AND -b.nxt > 0.7 * b.mag, false) AS reverts
FROM tr_move a JOIN tr_move b ON a.i = b.i AND a.delta < 0 AND b.delta > 0 AND a.prev > 0 AND b.prev > 0
""")
cte("tr_kept", """
SELECT * FROM tr_pair WHERE peak >= 10 AND (sym >= 0.6 OR abs(ma - mb) <= 2 * noise) AND NOT reverts
""")
cte("tr_ratio", """
SELECT p.fa, p.fb, p.i, x.i < p.i AS early, y.kwh / x.kwh AS r FROM tr_kept p JOIN tr_lag x ON x.feeder = p.fa JOIN tr_lag y ON y.feeder = p.fb AND y.i = x.i
""")
cte("tr_step", """
SELECT fa, fb, i, count(*) FILTER (WHERE early) AS nb, count(*) FILTER (WHERE NOT early) AS na, quantile_cont(r, 0.5) FILTER (WHERE early) AS mb,
  quantile_cont(r, 0.5) FILTER (WHERE NOT early) AS m_after, 1.4826 * mad(r) FILTER (WHERE early) AS sb, 1.4826 * mad(r) FILTER (WHERE NOT early) AS sa FROM tr_ratio GROUP BY 1, 2, 3
""")
cte("tr_found", """
SELECT p.* FROM tr_kept p JOIN tr_step s USING (fa, fb, i)
WHERE nb < 2 OR na < 2 OR (m_after > s.mb AND (sb + sa = 0 OR m_after - s.mb > 2 * (sb + sa)))
""")


def residuals(spark, d) -> DataFrame:
    return stage(transfers.residuals(head_energy(spark, d)), "residuals")


@query("head_residuals", "SELECT feeder, period, round(delta, 3) AS delta FROM tr_res")
def _(spark, d):
    return rounded(transfers.residuals(head_energy(spark, d)).select("feeder", "period", "delta"), delta=3)


@query("feeder_noise", "SELECT feeder, round(noise, 3) AS noise FROM tr_noise")
def _(spark, d):
    return rounded(transfers.feeder_noise(residuals(spark, d)).select("feeder", "noise"), noise=3)


_TR = """
SELECT fa AS feeder_a, fb AS feeder_b, period, round(da, 3) AS delta_a_kwh, round(db, 3) AS delta_b_kwh, round(magnitude, 3) AS magnitude_kwh,
  round(sym, 6) AS symmetry, NOT reverts AS sustained, round(least(greatest(0.5 * sym + 0.3 + 0.2 * least(peak / 100, 1), 0), 1), 6) AS confidence FROM {src}
"""
_TRC = dict(delta_a_kwh=3, delta_b_kwh=3, magnitude_kwh=3, symmetry=6, confidence=6)


@query("transfer_candidates", _TR.format(src="tr_found"))
def _(spark, d):
    return rounded(transfers.transfer_candidates(residuals(spark, d)), **_TRC)


@query("transfer_candidates_neighbours", _TR.format(src="tr_found") + """
WHERE abs(CAST(substr(fa, 2) AS INTEGER) - CAST(substr(fb, 2) AS INTEGER)) <= 3
""")
def _(spark, d):
    f = hierarchy(spark, d).select(F.col("feeder").alias("feeder_a"), F.substring("feeder", 2, 9).cast("int").alias("k"))
    near = f.withColumn("o", F.explode(F.array(*[F.lit(o) for o in (-3, -2, -1, 1, 2, 3)]))).select(
        "feeder_a", code("F", F.col("k") + F.col("o")).alias("feeder_b")).where(F.col("feeder_b").rlike("^F[0-9]{3}$"))
    return rounded(transfers.transfer_candidates(residuals(spark, d), neighbours=near), **_TRC)


@query("transfer_affected", "SELECT fa AS feeder FROM tr_found UNION SELECT fb FROM tr_found")
def _(spark, d):
    return transfers.affected_feeders(transfers.transfer_candidates(residuals(spark, d)))


@query("detection_floor", """
WITH r AS (SELECT abs(delta / prev) * 100 AS rel FROM tr_res WHERE prev > 0 AND delta IS NOT NULL),
m AS (SELECT quantile_cont(rel, 0.5) AS med, mad(rel) AS dev FROM r), k AS (SELECT quantile_cont(kwh, 0.5) AS size FROM tr_res)
SELECT round(med + 1.4826 * dev, 6) AS noise_pct, 10.0::DOUBLE AS threshold_pct, round(greatest(3 * (med + 1.4826 * dev), 10), 6) AS detectable_pct,
  round(greatest(3 * (med + 1.4826 * dev), 10) / 100 * size, 3) AS detectable_kwh FROM m, k
""")
def _(spark, d):
    return rounded(transfers.detection_floor(residuals(spark, d)), noise_pct=6, detectable_pct=6, detectable_kwh=3)


@query("detection_status", """
SELECT count(DISTINCT period) AS periods, CASE WHEN count(DISTINCT period) < 3 THEN 'NO_APLICABLE_POR_DATOS' ELSE 'OK' END AS status FROM head_energy
""")
def _(spark, d):
    return transfers.detection_status(head_energy(spark, d))
