"""Parsing, averages, demand, segmentation, signals and scoring of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.functions import classify as C
from wattledger.functions import conductors, electric, parse
from wattledger.operators import demand, peers, scoring, series, signals
from wattledger.params import PLAUSIBLE_KWH, TARIFF_CLASSES, Averaging, Demand
from wattledger.registry.core import cte, query
from wattledger.registry.inputs import (
    CLASS_CASE, DEMAND_CASE, MONTHS, VOLTAGE_CASE, customer_series, last_month, peer_customers,
    register, segmented, table,
)
from wattledger.staging import stage


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def pick(array: list[str], index) -> F.Column:
    return F.get(F.array(*[F.lit(x) for x in array]), index.cast("int"))


# --- text parsing ----------------------------------------------------------

# Sample texts assigned to the parts in turn.
TARIFF_TEXTS = [
    "RESIDENCIAL", "INDUSTRIAL CON DEMANDA MEDIA TENSION", "COMERCIAL SIN DEMANDA", "ALUMBRADO PUBLICO",
    "BOMBEO AGUA", "AGUA  POTABLE MT", "CULTO RELIGIOSO", "ENTIDADES PUBLICAS OFICIAL", "INDUSTRIAL ARTESANAL",
    "Residencial Dignidad baja tensión", "ESCENARIOS DEPORTIVOS", "NEGOCIO GENERAL BT", "ALTA TENSIÓN INDUSTRIAL",
    "TARIFA DESCONOCIDA", "", "BT Residencial", "MT Industrial",
]
CONDUCTOR_TEXTS = [
    "CONDUCTOR AAAC 6201 #397.5 MCM", "Conductor TW Cu # 3/0 AWG", "Conductor Clase 15kV Al 4/0 AWG",
    "CONDUCTOR ACSR #266 AWG", "CABLE MULTIPLEX ALUMINIO 2x6 AWG", "PREENSAMBLADO AL 3x50 + Nx70 MM2",
    "CABLE XLPE CU 35 MM2 25KV", "CONCENTRICO CU 2x8", "ALAMBRE COBRE #8 AWG", "CABLE SIN CALIBRE", "ACSR 69KV 477 MCM",
    "CABLE TTU CU 1/0 AWG", "Conductor Al 50,5 mm2",
]
KVA_TEXTS = ["15KVA", "37,5 KVA", "50", "75.0kva", "", "BANCO", "100 KVA", "22 KV"]
NUMBER_TEXTS = ["1.302", "963", "0", "", "nan", "NULL", "12,5", "1.234.567,89", "-45", "abc"]


def _parts(spark, d, texts: list[str]) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", "p_size", pick(texts, F.col("p_partkey") % len(texts)).alias("text"))


def _sql_pick(texts: list[str], key: str = "p_partkey") -> str:
    items = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"list_extract([{items}], CAST({key} % {len(texts)} AS INTEGER) + 1)"


@query("locale_numbers", f"""
SELECT p_partkey, text,
  CASE WHEN lower(trim(text)) IN ('', 'nan', 'none', 'null') THEN NULL
    ELSE TRY_CAST(replace(replace(trim(text), '.', ''), ',', '.') AS DOUBLE) END AS kwh
FROM (SELECT p_partkey, {_sql_pick(NUMBER_TEXTS)} AS text FROM part)
""")
def _(spark, d):
    p = _parts(spark, d, NUMBER_TEXTS)
    return p.select("p_partkey", "text", parse.locale_number(F.col("text")).alias("kwh"))


@query("coordinates", """
SELECT p_partkey, TRY_CAST(CAST(p_retailprice AS VARCHAR) AS DOUBLE) AS x,
  TRY_CAST(CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' ' || CAST(p_size AS VARCHAR) || '.25 ' END AS DOUBLE) AS y
FROM part
""")
def _(spark, d):
    y = F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(
        F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".25 ")))
    return table(spark, d, "part").select(
        "p_partkey",
        parse.coordinate(F.col("p_retailprice").cast("string")).alias("x"),
        parse.coordinate(y).alias("y"),
    )


@query("phase_masks", """
SELECT p_partkey, CAST(p_size % 8 AS INTEGER) AS mask,
  (CASE WHEN (p_size % 8) & 4 > 0 THEN 'A' ELSE '' END) || (CASE WHEN (p_size % 8) & 2 > 0 THEN 'B' ELSE '' END)
    || (CASE WHEN (p_size % 8) & 1 > 0 THEN 'C' ELSE '' END) AS phases,
  CAST(bit_count(CAST(p_size % 8 AS INTEGER)) AS INTEGER) AS n_phases
FROM part
""")
def _(spark, d):
    mask = (F.col("p_size") % 8).cast("int")
    return table(spark, d, "part").select(
        "p_partkey", mask.alias("mask"), parse.phase_letters(mask).alias("phases"),
        parse.phase_count(mask).alias("n_phases"),
    )


@query("transformer_capacities", f"""
WITH t AS (SELECT p_partkey, {_sql_pick(KVA_TEXTS)} AS text FROM part),
v AS (SELECT *, CAST(NULLIF(regexp_extract(replace(trim(replace(replace(upper(text), 'KVA', ''), 'KV', '')), ',', '.'), '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS kva FROM t)
SELECT p_partkey, text, kva,
  (SELECT min_by(dom, (abs(dom - kva), dom)) FROM (VALUES (10.0::DOUBLE), (15.0), (25.0), (37.5), (50.0), (75.0)) w(dom) WHERE kva IS NOT NULL) AS kva_valid
FROM v
""")
def _(spark, d):
    p = _parts(spark, d, KVA_TEXTS)
    return p.select("p_partkey", "text", parse.transformer_kva(F.col("text")).alias("kva"),
                    parse.transformer_kva(F.col("text"), [10.0, 15.0, 25.0, 37.5, 50.0, 75.0]).alias("kva_valid"))


@query("unit_capacities", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [CAST(p_size AS DOUBLE), CAST(p_size + 5 AS DOUBLE)]
  WHEN p_partkey % 3 = 1 THEN [CAST(p_size AS DOUBLE)] ELSE [] END AS kvas
FROM part
""")
def _(spark, d):
    text = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.array("p_size", F.col("p_size") + 5))).when(
        F.col("p_partkey") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit("KVA"))).otherwise(F.lit("BANCO"))
    return table(spark, d, "part").select("p_partkey", parse.unit_capacities(text).alias("kvas"))


@query("length_cascade", """
SELECT p_partkey,
  CASE WHEN fits_f THEN f WHEN fits_s THEN s ELSE shp END AS length,
  CASE WHEN fits_f THEN 'MEDIDO' WHEN fits_s THEN 'CATALOGO' ELSE 'INFERIDO_TOPOLOGIA' END AS origin
FROM (SELECT *, coalesce(f > 0 AND shp > 0 AND abs(f - shp) / nullif(shp, 0) <= 0.3, false) AS fits_f,
    coalesce(s > 0 AND shp > 0 AND abs(s - shp) / nullif(shp, 0) <= 0.3, false) AS fits_s
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS f,
    CAST(p_partkey % 60 AS DOUBLE) AS s, CAST(p_partkey % 50 AS DOUBLE) AS shp FROM part))
""")
def _(spark, d):
    k = F.col("p_partkey")
    got = parse.length_with_origin(
        F.when(k % 4 != 0, F.col("p_size").cast("double")), (k % 60).cast("double"), (k % 50).cast("double"))
    return table(spark, d, "part").select("p_partkey", got.alias("g")).select("p_partkey", "g.length", "g.origin")


STRUCTURE_CODES = ["APO123", "CSP1", "TRT9", "COO44", "ECT2", "ECS1", "med7", "POO1", "SPD3", "SDT4", "ESV0", "EU0X", "ZZZ", ""]


@query("structure_categories", f"""
SELECT p_partkey, code, CASE WHEN p3 LIKE 'SD%' THEN 'GENERACION'
  WHEN p3 IN ('APO','AOD','AOC') THEN 'ALUMBRADO' WHEN p3 = 'CSP' THEN 'SEMAFORO_CAMARA'
  WHEN p3 IN ('TRT','TRR','TRV','TRS','TUT','TUV','TUS') THEN 'TRANSFORMADOR' WHEN p3 = 'COO' THEN 'CONDUCTOR'
  WHEN p3 IN ('ECT','ECR') THEN 'CAPACITOR' WHEN p3 IN ('ECS','ECV') THEN 'REGULADOR'
  WHEN p3 IN ('MED','MEC','MET','MEV','MEU') THEN 'MEDIDOR' WHEN p3 IN ('POO','TOO') THEN 'POSTE'
  WHEN p3 IN ('SPT','SPV','SPR','SPS','SPO','SPD','SPE','SST','SSV','SSS','SSD') THEN 'SECCIONADOR'
  WHEN p3 IN ('EST','ESV','ESR','ESS','ESD','ESN','ESE','ESC','EU0') THEN 'ESTRUCTURA' ELSE 'OTRO' END AS category
FROM (SELECT p_partkey, code, upper(substr(code, 1, 3)) AS p3 FROM (SELECT p_partkey, {_sql_pick(STRUCTURE_CODES)} AS code FROM part))
""")
def _(spark, d):
    p = _parts(spark, d, STRUCTURE_CODES).withColumnRenamed("text", "code")
    return p.select("p_partkey", "code", parse.structure_category(F.col("code")).alias("category"))


@query("conductor_parameters", f"""
WITH t AS (SELECT p_partkey, {_sql_pick(CONDUCTOR_TEXTS)} AS description FROM part),
u AS (SELECT *, upper(replace(description, ',', '.')) AS up FROM t),
g AS (SELECT *,
  CASE WHEN up LIKE '%ACSR%' THEN 'ACSR' WHEN regexp_matches(up, 'AAAC|6201|ALEACI[OÓ]N') THEN 'AAAC'
    WHEN regexp_matches(up, '\\bCU\\b|COBRE') THEN 'CU' ELSE 'AL' END AS material,
  CAST(nullif(regexp_extract(up, '(\\d+(?:\\.\\d+)?)\\s*KV', 1), '') AS DOUBLE) AS kv,
  regexp_matches(up, 'TTU|SUBTERR|XLPE|CLASE') AS underground,
  nullif(regexp_extract(up, '(\\d+(?:\\.\\d+)?)\\s*(?:MCM|KCMIL)', 1), '') AS kc,
  nullif(regexp_extract(up, '#?\\s*(\\d{{1,2}}/0|\\d{{1,4}})\\s*AWG', 1), '') AS awg,
  nullif(regexp_extract(up, '(\\d+)\\s*X\\s*(\\d+(?:/0)?)', 1), '') AS nx,
  nullif(regexp_extract(up, '(\\d+)\\s*X\\s*(\\d+(?:/0)?)', 2), '') AS sx,
  nullif(regexp_extract(up, '(\\d+(?:\\.\\d+)?)\\s*MM2', 1), '') AS mm,
  regexp_matches(up, 'MM\\s*2|MM²|\\bMM\\b') AS metric FROM u),
n AS (SELECT *,
  CASE WHEN regexp_matches(awg, '^[1-4]/0$') THEN 1 - CAST(left(awg, 1) AS INTEGER)
    WHEN regexp_matches(awg, '^0+$') THEN 1 - length(awg) ELSE TRY_CAST(awg AS INTEGER) END AS na,
  CASE WHEN regexp_matches(sx, '^[1-4]/0$') THEN 1 - CAST(left(sx, 1) AS INTEGER)
    WHEN regexp_matches(sx, '^0+$') THEN 1 - length(sx) ELSE TRY_CAST(sx AS INTEGER) END AS ns FROM g),
a AS (SELECT *,
  CASE WHEN na BETWEEN -3 AND 40 THEN pi() * pow(0.127 * pow(92.0::DOUBLE, (36 - na) / 39.0::DOUBLE) / 2, 2) END AS awg_area,
  CASE WHEN ns BETWEEN -3 AND 40 THEN pi() * pow(0.127 * pow(92.0::DOUBLE, (36 - ns) / 39.0::DOUBLE) / 2, 2) END AS strand_area FROM n),
f AS (SELECT *, coalesce(CAST(kc AS DOUBLE) * 0.5067074, awg_area,
    CASE WHEN TRY_CAST(awg AS DOUBLE) > 40 THEN TRY_CAST(awg AS DOUBLE) * 0.5067074 END,
    CASE WHEN metric THEN TRY_CAST(sx AS DOUBLE) ELSE strand_area END, CAST(mm AS DOUBLE)) AS area_mm2,
  CASE WHEN kv >= 46 THEN 'AT' WHEN kv >= 1 THEN 'MT'
    WHEN regexp_matches(up, 'TW|THHN|TTU|CONC[EÉ]NTRIC|MULTIPLEX|MULTICONDUCTOR|PREENSAMBLAD') THEN 'BT' ELSE 'MT' END AS voltage_class,
  CASE WHEN kc IS NOT NULL THEN kc || ' kcmil' WHEN awg_area IS NOT NULL THEN awg || ' AWG'
    WHEN TRY_CAST(awg AS DOUBLE) > 40 THEN awg || ' kcmil (etiquetado AWG)'
    WHEN metric AND TRY_CAST(sx AS DOUBLE) IS NOT NULL THEN nx || 'x' || sx || ' mm2'
    WHEN NOT metric AND strand_area IS NOT NULL THEN nx || 'x' || sx || ' AWG'
    WHEN mm IS NOT NULL THEN mm || ' mm2' END AS gauge FROM a)
SELECT p_partkey, material, voltage_class, underground, gauge, round(area_mm2, 3) AS area_mm2,
  round(CASE material WHEN 'CU' THEN 0.017774 WHEN 'AAAC' THEN 0.0326 ELSE 0.028264 END * 1000 / area_mm2 * 1.02, 5) AS r_ohm_km,
  round(CASE WHEN area_mm2 IS NOT NULL THEN 2 * pi() * 60 * 2e-4 * ln((CASE WHEN underground THEN 0.15 WHEN voltage_class = 'BT' THEN 0.3 WHEN voltage_class = 'MT' THEN 1.0 ELSE 3.0 END)
    / (0.7788 * sqrt(area_mm2 / pi()) / 1000)) END, 5) AS x_ohm_km,
  round(CASE material WHEN 'CU' THEN 15.9 WHEN 'AAAC' THEN 12.4 ELSE 12.6 END * pow(area_mm2, 0.72) * CASE WHEN underground THEN 0.75 ELSE 1 END, 1) AS ampacity_a
FROM f
""")
def _(spark, d):
    p = _parts(spark, d, CONDUCTOR_TEXTS).select("p_partkey", F.col("text").alias("description"))
    out = conductors.conductor_columns(p).drop("description")
    return rounded(out, area_mm2=3, r_ohm_km=5, x_ohm_km=5, ampacity_a=1)


@query("tariff_classes", f"""
SELECT p_partkey, tariff, {CLASS_CASE} AS consumption_class, {VOLTAGE_CASE} AS voltage_level, {DEMAND_CASE} AS with_demand
FROM (SELECT p_partkey, {_sql_pick(TARIFF_TEXTS)} AS tariff FROM part)
""")
def _(spark, d):
    p = _parts(spark, d, TARIFF_TEXTS).select("p_partkey", F.col("text").alias("tariff"))
    return C.classify_distinct(p)


@query("tariff_catalogue_key", f"""
WITH t AS (SELECT p_partkey, tariff, {CLASS_CASE} AS c, {VOLTAGE_CASE} AS v
  FROM (SELECT p_partkey, {_sql_pick(TARIFF_TEXTS)} AS tariff FROM part)),
k(ord, key, c, v) AS (VALUES (1, 'BT Residencial', 'RESIDENCIAL', 'BT'), (2, 'BT Comercial', 'COMERCIAL', 'BT'),
  (3, 'BT Industrial', 'INDUSTRIAL', 'BT'), (4, 'MT Industrial', 'INDUSTRIAL', 'MT'))
SELECT p_partkey, tariff, coalesce((SELECT key FROM k WHERE key = tariff),
  (SELECT min_by(key, ord) FROM k WHERE k.c = t.c AND k.v = t.v), (SELECT min_by(key, ord) FROM k WHERE k.c = t.c)) AS class_key
FROM t
""")
def _(spark, d):
    p = _parts(spark, d, TARIFF_TEXTS)
    return p.select("p_partkey", F.col("text").alias("tariff"), C.catalogue_key(F.col("text"), list(TARIFF_CLASSES)).alias("class_key"))


# --- readings --------------------------------------------------------------

@query("wide_readings_to_long", """
WITH w AS (SELECT c_custkey AS account, c_acctbal AS a FROM customer),
l AS (SELECT account, CAST(final_month - INTERVAL 2 MONTH AS DATE) AS period, a AS kwh FROM w CROSS JOIN axis_end
  UNION ALL SELECT account, CAST(final_month - INTERVAL 1 MONTH AS DATE), CASE WHEN account % 4 = 0 THEN NULL ELSE CAST(account AS DOUBLE) END FROM w CROSS JOIN axis_end
  UNION ALL SELECT account, final_month, 0.0 FROM w CROSS JOIN axis_end)
SELECT account, period, CASE WHEN kwh < 0 THEN NULL ELSE kwh END AS kwh, coalesce(kwh = 0, false) AS is_zero,
  coalesce(kwh < 0, false) AS is_negative FROM l
""")
def _(spark, d):
    c = table(spark, d, "customer")
    wide = c.select(
        F.col("c_custkey").alias("account"),
        F.lit("0").alias("KWH_10"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey").cast("string")).otherwise(F.lit("")).alias("KWH_9"),
        F.replace(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")).alias("KWH_2"),
    )
    return series.flag_readings(series.unpivot_readings(wide, "account", last_month(spark, d)))


@query("first_row_per_account", """
SELECT account, o_orderkey, o_totalprice FROM (
  SELECT o_custkey AS account, o_orderkey, o_totalprice,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1
""")
def _(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("account"), "o_orderkey", "o_totalprice", "o_orderdate")
    return series.first_per_account(o, [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("orientation_check", """
WITH w AS (SELECT o_custkey AS account,
  sum(o_totalprice) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-01-01') AS newest,
  sum(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS oldest,
  sum(o_totalprice) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-01-01') AS reported FROM orders GROUP BY 1),
s AS (SELECT count(*) AS n_rows, corr(newest, reported) AS a, corr(oldest, reported) AS b FROM w
  WHERE newest IS NOT NULL AND oldest IS NOT NULL AND reported > 0)
SELECT n_rows, round(a, 6) AS corr_newest, round(b, 6) AS corr_oldest, n_rows < 30 OR a + 1e-9 >= b AS oriented FROM s
""")
def _(spark, d):
    day = F.col("o_orderdate")
    part = lambda cond: F.sum(F.when(cond, F.col("o_totalprice")))
    w = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("account")).agg(
        part(day >= "2000-01-01").alias("newest"), part(day < "1998-01-01").alias("oldest"),
        part(day >= "2001-01-01").alias("reported"))
    return rounded(series.orientation(w, "newest", "oldest", "reported"), corr_newest=6, corr_oldest=6)


@query("plausible_ranges", f"""
WITH k(ord, key, c, v, lo, hi) AS (VALUES (1, 'BT Residencial', 'RESIDENCIAL', 'BT', 0, 250), (2, 'BT Comercial', 'COMERCIAL', 'BT', 0, 30000),
  (3, 'BT Industrial', 'INDUSTRIAL', 'BT', 0, 200000), (4, 'MT Industrial', 'INDUSTRIAL', 'MT', 0, 5000000)),
r AS (SELECT c.*, coalesce((SELECT min_by(key, ord) FROM k WHERE k.c = consumption_class AND k.v = voltage_level),
  (SELECT min_by(key, ord) FROM k WHERE k.c = consumption_class)) AS class_key FROM classified c)
SELECT class_key, count(*) AS customers, round(avg(CASE WHEN scaled < lo OR scaled > hi THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_outside,
  avg(CASE WHEN scaled < lo OR scaled > hi THEN 1.0 ELSE 0.0 END) * 100 > 5 AS warning
FROM (SELECT class_key, mean_kwh * 2 AS scaled FROM r WHERE mean_kwh IS NOT NULL) JOIN (SELECT key, lo, CASE WHEN key = 'BT Residencial' THEN 5000 ELSE hi END AS hi FROM k) ON key = class_key GROUP BY 1
""")
def _(spark, d):
    s = customer_series(spark, d).withColumn("mean_kwh", F.col("mean_kwh") * 2)
    return rounded(series.plausible_range(s), pct_outside=6)


@query("register_enrichment", """
SELECT r.account, r.tariff, coalesce(upper(trim(state)) = 'ACT', true) AS active, coalesce(TRY_CAST(phases_text AS INTEGER), 1) AS phases, p_prev_kw, q_prev_kvar
FROM (SELECT account, tariff FROM register) r LEFT JOIN (
  SELECT c_custkey AS account, CASE c_custkey % 4 WHEN 0 THEN 'ACT' WHEN 1 THEN 'SUSP' WHEN 2 THEN ' act ' END AS state,
    CASE c_custkey % 5 WHEN 0 THEN 'x' ELSE CAST(c_custkey % 5 AS VARCHAR) END AS phases_text,
    c_acctbal / 10 AS p_prev_kw, c_acctbal / 20 AS q_prev_kvar FROM customer WHERE c_custkey % 7 <> 0) a ON a.account = r.account
""")
def _(spark, d):
    k = F.col("c_custkey")
    aux = table(spark, d, "customer").where(k % 7 != 0).select(
        k.alias("account"),
        F.when(k % 4 == 0, "ACT").when(k % 4 == 1, "SUSP").when(k % 4 == 2, " act ").alias("state"),
        F.when(k % 5 == 0, F.lit("x")).otherwise((k % 5).cast("string")).alias("phases_text"),
        (F.col("c_acctbal") / 10).alias("p_prev_kw"), (F.col("c_acctbal") / 20).alias("q_prev_kvar"))
    return series.enrich_register(register(spark, d).select("account", "tariff"), aux)


cte("win", """
SELECT r.account, r.i, r.kwh, g.active FROM readings r JOIN (SELECT account, active FROM register) g USING (account)
WHERE r.i >= 24 AND r.kwh IS NOT NULL AND (g.active OR r.kwh > 0)
""")
cte("win_pos", """
SELECT *, row_number() OVER (PARTITION BY account ORDER BY kwh) - 1 AS p, count(*) OVER (PARTITION BY account) AS n FROM win
""")
cte("averages", """
SELECT s.account, coalesce(v.n, 0) AS n_valid, v.cv, coalesce(v.avg_kwh, 0) AS avg_kwh
FROM seen_accounts s LEFT JOIN (SELECT account, count(*) AS n, CASE WHEN avg(kwh) > 0 THEN stddev_pop(kwh) / avg(kwh) END AS cv,
  avg(kwh) FILTER (WHERE p >= floor(n * 0.1) AND p < n - floor(n * 0.1)) AS avg_kwh FROM win_pos GROUP BY account) v USING (account)
""")


def _averages(method: str, spark, d) -> DataFrame:
    s = customer_series(spark, d).withColumn("suspended", ~F.col("active"))
    out = series.representative_average(s, Averaging(method=method), first_month=8)
    return rounded(out.select("account", "avg_kwh", "n_valid", "cv", "reliable"), avg_kwh=6, cv=6)


_AVG_SQL = """
SELECT s.account, round(coalesce(v.a, 0), 6) AS avg_kwh, CAST(coalesce(v.n, 0) AS INTEGER) AS n_valid, round(v.cv, 6) AS cv, coalesce(v.n, 0) >= 3 AS reliable
FROM seen_accounts s LEFT JOIN (SELECT account, count(*) AS n, CASE WHEN avg(kwh) > 0 THEN stddev_pop(kwh) / avg(kwh) END AS cv, {expr} AS a
  FROM win_pos GROUP BY account) v USING (account)
"""
_METHODS = {
    "mean": "avg(kwh)",
    "trimmed": "avg(kwh) FILTER (WHERE p >= floor(n * 0.1) AND p < n - floor(n * 0.1))",
    "median": "quantile_cont(kwh, 0.5)",
    "recency": "sum(kwh * pow(0.5, (35 - i) / 6.0)) / sum(pow(0.5, (35 - i) / 6.0))",
}
for _m, _expr in _METHODS.items():
    query(f"average_{_m}", _AVG_SQL.format(expr=_expr))(lambda spark, d, m=_m: _averages(m, spark, d))


@query("average_seasonal", """
WITH by_month AS (SELECT account, (i + 7) % 12 AS m, avg(kwh) AS a FROM win GROUP BY 1, 2)
SELECT s.account, round(coalesce((SELECT avg(a) FROM by_month b WHERE b.account = s.account), 0), 6) AS avg_kwh,
  CAST(n_valid AS INTEGER) AS n_valid, round(cv, 6) AS cv, n_valid >= 3 AS reliable FROM averages s
""")
def _(spark, d):
    return _averages("seasonal", spark, d)


@query("own_base_level", "SELECT account, round(base_kwh, 6) AS base_kwh, round(mean_kwh, 6) AS mean_kwh FROM stats")
def _(spark, d):
    return rounded(customer_series(spark, d).select("account", "base_kwh", "mean_kwh"), base_kwh=6, mean_kwh=6)


@query("ordered_series", """
SELECT account, list(kwh ORDER BY i) AS series FROM readings GROUP BY account
""")
def _(spark, d):
    return customer_series(spark, d).select("account", "series")


# --- demand ----------------------------------------------------------------

cte("coef", """
SELECT * FROM (VALUES ('BT Residencial', 0.0002::DOUBLE, 0.03::DOUBLE, 0.92::DOUBLE, 0.42::DOUBLE), ('BT Comercial', 0.00025, 0.035, 0.90, 0.50),
  ('BT Industrial', 0.0003, 0.04, 0.88, 0.65), ('MT Industrial', 0.00035, 0.045, 0.92, 0.75)) t(class_key, a, b, cos_phi, load_factor)
""")
cte("power", """
SELECT *, CASE WHEN phases <= 1 THEN s_kva * 1000 / 127 WHEN phases = 2 THEN s_kva * 1000 / 220 ELSE s_kva * 1000 / (sqrt(3) * 220) END AS current_a
FROM (SELECT *, sqrt(p_max_kw * p_max_kw + q_kvar * q_kvar) AS s_kva FROM (
  SELECT *, p_max_kw * tan(acos(cos_phi)) AS q_kvar FROM (
    SELECT c.account, c.division, c.tariff, c.phases, c.p_prev_kw, c.q_prev_kvar, v.avg_kwh AS energy_used, v.avg_kwh / 720 AS p_avg_kw,
      a * v.avg_kwh + b * sqrt(v.avg_kwh) AS p_max_kw, v.avg_kwh / 720 / load_factor AS p_max_lf, cos_phi
    FROM classified c JOIN averages v USING (account)
    JOIN coef ON class_key = CASE consumption_class WHEN 'RESIDENCIAL' THEN 'BT Residencial' WHEN 'COMERCIAL' THEN 'BT Comercial'
      WHEN 'INDUSTRIAL' THEN CASE WHEN voltage_level = 'MT' THEN 'MT Industrial' ELSE 'BT Industrial' END ELSE 'BT Residencial' END)))
""")


def power(spark, d) -> DataFrame:
    s = customer_series(spark, d).withColumn("suspended", ~F.col("active"))
    return demand.recompute_power(series.representative_average(s))


@query("customer_power", """
SELECT account, round(energy_used, 6) AS energy_used, round(p_avg_kw, 6) AS p_avg_kw, round(p_max_kw, 6) AS p_max_kw,
  round(q_kvar, 6) AS q_kvar, round(s_kva, 6) AS s_kva, round(current_a, 6) AS current_a, cos_phi, phases AS phase_count FROM power
""")
def _(spark, d):
    cols = ["energy_used", "p_avg_kw", "p_max_kw", "q_kvar", "s_kva", "current_a"]
    return rounded(power(spark, d).select("account", *cols, "cos_phi", "phase_count"), **{c: 6 for c in cols})


@query("customer_power_load_factor", "SELECT account, round(p_max_lf, 6) AS p_max_kw FROM power")
def _(spark, d):
    s = customer_series(spark, d).withColumn("suspended", ~F.col("active"))
    out = demand.recompute_power(series.representative_average(s), Demand(method="load_factor"))
    return rounded(out.select("account", "p_max_kw"), p_max_kw=6)


@query("coincident_demand", """
SELECT site, count(*) AS customers, round(greatest(0.2 + 0.8 / sqrt(count(*)), 0.15), 6) AS coincidence,
  round(sum(p_max_kw) * greatest(0.2 + 0.8 / sqrt(count(*)), 0.15), 4) AS diversified_kw
FROM power JOIN (SELECT account, site FROM register) USING (account) GROUP BY site
""")
def _(spark, d):
    g = power(spark, d).groupBy("site").agg(F.count(F.lit(1)).alias("customers"), F.sum("p_max_kw").alias("p"))
    fc = electric.coincidence(F.col("customers"), F.lit(0.2), F.lit(0.8), Demand().min_coincidence)
    return rounded(g.select("site", "customers", fc.alias("coincidence"), (F.col("p") * fc).alias("diversified_kw")),
                   coincidence=6, diversified_kw=4)


cte("reconciled", """
SELECT account, division, tariff AS tariff_class, p_prev_kw, p_max_kw AS p_new_kw, p_max_kw - p_prev_kw AS delta_p_kw,
  (p_max_kw - p_prev_kw) * 100 / nullif(abs(p_prev_kw), 0) AS delta_p_pct, q_prev_kvar, q_kvar AS q_new_kvar, q_kvar - q_prev_kvar AS delta_q_kvar,
  energy_used / 720 - energy_used AS cause_energy_as_demand, 0.0::DOUBLE AS cause_period_days, 0.0::DOUBLE AS cause_coincidence,
  (current_a - s_kva * 1000 / (sqrt(3) * 220)) * 127 / 1000 AS cause_sqrt3, 0.0::DOUBLE AS cause_cos_phi, 0.0::DOUBLE AS cause_multiplier
FROM power
""")


def _reconciled(spark, d) -> DataFrame:
    return demand.reconcile(register(spark, d), power(spark, d))


_REC = ["p_new_kw", "delta_p_kw", "delta_p_pct", "q_new_kvar", "delta_q_kvar", "cause_energy_as_demand", "cause_sqrt3"]


@query("power_reconciliation", "SELECT account, division, tariff_class, p_prev_kw, q_prev_kvar, cause_period_days, cause_coincidence, cause_cos_phi, cause_multiplier, "
       + ", ".join(f"round({c}, 8) AS {c}" for c in _REC) + " FROM reconciled")
def _(spark, d):
    return rounded(_reconciled(spark, d), **{c: 8 for c in _REC})


@query("reconciliation_by_class", """
SELECT division, tariff_class, count(*) AS n, round(sum(p_prev_kw), 4) AS p_prev_sum, round(sum(p_new_kw), 4) AS p_new_sum,
  round(sum(delta_p_kw), 4) AS delta_p_sum, round(sum(delta_p_kw) / nullif(abs(sum(p_prev_kw)), 0) * 100, 4) AS delta_p_pct
FROM reconciled GROUP BY 1, 2
""")
def _(spark, d):
    return rounded(demand.reconciliation_by_class(_reconciled(spark, d)), p_prev_sum=4, p_new_sum=4, delta_p_sum=4, delta_p_pct=4)


@query("reconciliation_causes", """
SELECT count(*) AS n, round(sum(p_prev_kw), 4) AS p_prev_total, round(sum(p_new_kw), 4) AS p_new_total, round(sum(delta_p_kw), 4) AS delta_p_total,
  round(sum(cause_energy_as_demand), 4) AS cause_energy_as_demand, 0.0::DOUBLE AS cause_period_days, 0.0::DOUBLE AS cause_coincidence,
  round(sum(cause_sqrt3), 4) AS cause_sqrt3, 0.0::DOUBLE AS cause_cos_phi, 0.0::DOUBLE AS cause_multiplier FROM reconciled
""")
def _(spark, d):
    return rounded(demand.reconciliation_causes(_reconciled(spark, d)), p_prev_total=4, p_new_total=4, delta_p_total=4,
                   cause_energy_as_demand=4, cause_sqrt3=4)


# --- segments and peers ----------------------------------------------------

@query("customer_segments", """
SELECT account, consumption_class, voltage_level, with_demand, round(base_kwh, 6) AS base_kwh, stratum, segment, is_large, peer_eligible FROM segmented
""")
def _(spark, d):
    cols = ["account", "consumption_class", "voltage_level", "with_demand", "base_kwh", "stratum", "segment", "is_large", "peer_eligible"]
    return rounded(segmented(spark, d).select(*cols), base_kwh=6)


for _by in ("consumption_class", "segment"):
    @query(f"summary_by_{_by}", f"""
    SELECT {_by}, count(*) AS customers, round(sum(coalesce(base_kwh, 0)), 4) AS base_kwh_month,
      round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM segmented), 2) AS pct_customers,
      round(sum(coalesce(base_kwh, 0)) / (SELECT sum(base_kwh) FROM segmented) * 100, 2) AS pct_energy
    FROM segmented GROUP BY 1
    """)
    def _(spark, d, by=_by):
        return rounded(peers.segment_summary(segmented(spark, d), by), base_kwh_month=4)


@query("segmentation_coverage", """
SELECT count(*) AS customers, CAST(sum(CASE WHEN consumption_class = 'NO_CLASIFICADO' THEN 1 ELSE 0 END) AS BIGINT) AS unclassified,
  round(avg(CASE WHEN consumption_class <> 'NO_CLASIFICADO' THEN 1.0 ELSE 0.0 END) * 100, 4) AS coverage_pct,
  round(sum(CASE WHEN consumption_class <> 'RESIDENCIAL' THEN base_kwh ELSE 0 END) / sum(base_kwh) * 100, 4) AS non_residential_energy_pct FROM segmented
""")
def _(spark, d):
    return rounded(peers.segmentation_coverage(segmented(spark, d)), coverage_pct=4, non_residential_energy_pct=4)


@query("peer_groups", "SELECT account, peer_group, peer_level, peer_confidence, peer_n FROM peered")
def _(spark, d):
    return peer_customers(spark, d).select("account", "peer_group", "peer_level", "peer_confidence", "peer_n")


@query("peer_level_summary", """
SELECT peer_level, count(*) AS customers, max(peer_confidence) AS confidence, round(avg(peer_n), 1) AS mean_size,
  round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM peered), 1) AS pct FROM peered GROUP BY 1
""")
def _(spark, d):
    return peers.peer_level_summary(peer_customers(spark, d))


def averaged(spark, d) -> DataFrame:
    """Staged customers with series, segment and representative average."""
    s = segmented(spark, d).withColumn("suspended", ~F.col("active"))
    return stage(series.representative_average(s).drop("suspended"), "customers")


def profiled(spark, d, base: DataFrame | None = None) -> DataFrame:
    """Customers with peer group and representative average over a staged table."""
    return peers.assign_peer_group(base or averaged(spark, d))


cte("expected", """
SELECT peer_group, quantile_cont(avg_kwh, 0.5) AS expected_kwh FROM peered JOIN averages USING (account) WHERE peer_group IS NOT NULL GROUP BY 1
""")


@query("expected_consumption", "SELECT peer_group, round(expected_kwh, 6) AS expected_kwh FROM expected")
def _(spark, d):
    return rounded(peers.expected_by_group(profiled(spark, d)), expected_kwh=6)


@query("recoverable_by_customer", """
SELECT account, round(greatest(coalesce(base_kwh - avg_kwh, 0), coalesce(expected_kwh - avg_kwh, 0), 0), 6) AS recoverable_kwh
FROM peered JOIN averages USING (account) LEFT JOIN expected USING (peer_group)
""")
def _(spark, d):
    df = peers.with_expected(profiled(spark, d))
    return df.select("account", F.round(peers.recoverable(F.col("avg_kwh"), F.col("expected_kwh"), F.col("base_kwh")), 6).alias("recoverable_kwh"))


# --- signals ---------------------------------------------------------------

cte("s1_base", """
SELECT account, max(n) AS n, quantile_cont(kwh, 0.5) AS base FROM finite WHERE pos < greatest(3, n // 4) GROUP BY account
""")
cte("s1_low", """
SELECT f.account, f.pos, f.kwh, b.base, b.n, f.kwh < b.base * 0.6 AS low,
  f.pos - row_number() OVER (PARTITION BY f.account, f.kwh < b.base * 0.6 ORDER BY f.pos) AS island
FROM finite f JOIN s1_base b USING (account)
""")
cte("s1_runs", """
SELECT account, count(*) AS len, max(pos) AS last FROM s1_low WHERE low GROUP BY account, island
""")
cte("s1_best", """
SELECT account, max(len) AS len, min_by(last, (-len, last)) AS last FROM s1_runs GROUP BY account
""")
cte("s1", """
SELECT b.account, CASE WHEN b.n >= 8 AND b.base > 0 AND r.len >= 3
  AND EXISTS (SELECT 1 FROM finite f WHERE f.account = b.account AND f.pos > r.last AND f.kwh >= b.base * 0.85)
  THEN least(1.0, r.len / 3.0 * 0.6) ELSE 0.0 END AS v
FROM s1_base b LEFT JOIN s1_best r USING (account)
""")
cte("s3_split", """
SELECT account, pos, n, sum(kwh) OVER w AS before_sum, sum(kwh) OVER (PARTITION BY account) AS total FROM finite
WINDOW w AS (PARTITION BY account ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
cte("s3_delta", """
SELECT account, pos, m1, m2, abs(m2 - m1) / greatest(m1, 1e-6) AS delta FROM (
  SELECT account, pos, before_sum / pos AS m1, (total - before_sum) / (n - pos) AS m2 FROM s3_split WHERE pos >= 3 AND pos < n - 3 AND n >= 8)
""")
cte("s3_best", """
SELECT account, m1, m2, delta FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY round(delta, 9) DESC, pos) AS rn FROM s3_delta) WHERE rn = 1
""")
cte("s4_runs", """
SELECT account, max(len) AS best FROM (SELECT account, count(*) AS len FROM (
  SELECT account, i, kwh, i - row_number() OVER (PARTITION BY account, coalesce(kwh, -1) = 0 ORDER BY i) AS island FROM readings)
  WHERE kwh = 0 GROUP BY account, island) GROUP BY account
""")
cte("s7_cv", """
SELECT account, stddev_pop(kwh) / avg(kwh) AS cv FROM finite WHERE kwh > 0 GROUP BY account HAVING count(*) >= 6
""")
cte("s5_group", """
SELECT peer_group, count(*) AS n, quantile_cont(mean_kwh, 0.05) AS p5, quantile_cont(mean_kwh, 0.5) AS p50 FROM peered WHERE peer_group IS NOT NULL GROUP BY 1
""")
cte("s8_site", """
SELECT site, count(*) AS n, avg(mean_kwh) AS m, stddev_pop(mean_kwh) AS sd FROM peered GROUP BY 1
""")
cte("signals", """
SELECT p.account, p.consumption_class, p.voltage_level, p.segment, p.is_large, p.peer_group, p.peer_level, p.base_kwh, p.site, p.feeder, p.route, p.tariff, p.x, p.y,
  coalesce(s1.v, 0) AS S1,
  CASE WHEN s3_best.delta * 100 >= 30 AND s3_best.m2 < s3_best.m1 THEN least(1.0, s3_best.delta) ELSE 0.0 END AS S3,
  CASE WHEN p.active AND s4_runs.best >= 3 THEN least(1.0, s4_runs.best / 6.0) ELSE 0.0 END AS S4,
  CASE WHEN s5_group.n >= 5 AND s5_group.p50 > 0 AND p.mean_kwh < s5_group.p5 THEN greatest(least(1 - p.mean_kwh / s5_group.p50, 1.0), 0.0) * p.peer_confidence ELSE 0.0 END AS S5,
  CASE WHEN s7_cv.cv < 0.05 THEN least(1.0, 1 - s7_cv.cv / 0.05) ELSE 0.0 END AS S7,
  CASE WHEN s8_site.n >= 3 AND s8_site.m > 0 AND s8_site.sd / s8_site.m >= 0.6 AND p.mean_kwh < s8_site.m THEN greatest(least(1 - p.mean_kwh / s8_site.m, 1.0), 0.0) ELSE 0.0 END AS S8,
  CASE WHEN p.base_kwh > 0 AND 1 - p.mean_kwh / p.base_kwh >= 0.35 THEN least(1 - p.mean_kwh / p.base_kwh, 1.0) ELSE 0.0 END AS S9
FROM peered p LEFT JOIN s1 USING (account) LEFT JOIN s3_best USING (account) LEFT JOIN s4_runs USING (account) LEFT JOIN s7_cv USING (account)
LEFT JOIN s5_group USING (peer_group) LEFT JOIN s8_site USING (site)
""")


def _signal_sql(*names: str) -> str:
    return "SELECT account, " + ", ".join(f"round({n}, 6) AS {n}" for n in names) + " FROM signals"


@query("signal_drop_recovery", _signal_sql("S1"))
def _(spark, d):
    return rounded(signals.drop_and_recovery(customer_series(spark, d)).select("account", "S1"), S1=6)


@query("signal_level_break", _signal_sql("S3"))
def _(spark, d):
    return rounded(signals.level_break(customer_series(spark, d)).select("account", "S3"), S3=6)


@query("signal_zero_run", _signal_sql("S4"))
def _(spark, d):
    return rounded(signals.zero_run(customer_series(spark, d)).select("account", "S4"), S4=6)


@query("signal_flatness", """
WITH q AS (SELECT l_suppkey AS account, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS t, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY 1, 2),
c AS (SELECT account, stddev_pop(v) / avg(v) AS cv, count(*) AS n FROM q WHERE v > 0 GROUP BY 1)
SELECT account, round(CASE WHEN n >= 6 AND cv < 0.5 THEN least(1.0, 1 - cv / 0.5) ELSE 0.0 END, 6) AS S7 FROM c
""")
def _(spark, d):
    from wattledger.params import Signals

    q = table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("account"), F.trunc("l_shipdate", "quarter").alias("t")).agg(F.round(F.sum("l_quantity"), 2).alias("v"))
    # At most one entry per quarter of the axis.
    s = q.groupBy("account").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("a")).select(
        "account", F.col("a.v").alias("finite"))
    return rounded(signals.flatness(s, Signals(s7_cv_max=0.5)).select("account", "S7"), S7=6)


@query("signal_below_peers", _signal_sql("S5"))
def _(spark, d):
    return rounded(signals.below_peers(profiled(spark, d)).select("account", "S5"), S5=6)


@query("signal_below_site", _signal_sql("S8"))
def _(spark, d):
    return rounded(signals.below_site(customer_series(spark, d)).select("account", "S8"), S8=6)


@query("signal_own_base_deficit", _signal_sql("S9"))
def _(spark, d):
    return rounded(signals.below_own_base(customer_series(spark, d)).select("account", "S9"), S9=6)


def signal_table(spark, d, base: DataFrame | None = None) -> DataFrame:
    return stage(canonical(signals.signal_matrix(profiled(spark, d, base))), "signals")


@query("signal_matrix", _signal_sql("S1", "S3", "S4", "S5", "S7", "S8", "S9"))
def _(spark, d):
    names = ["S1", "S3", "S4", "S5", "S7", "S8", "S9"]
    return rounded(signals.signal_matrix(profiled(spark, d)).select("account", *names), **{n: 6 for n in names})


@query("signal_evidence", """
SELECT account, CAST((S1 > 0)::INT + (S3 > 0)::INT + (S4 > 0)::INT + (S5 > 0)::INT + (S7 > 0)::INT + (S8 > 0)::INT + (S9 > 0)::INT AS INTEGER) AS n_records,
  concat_ws(',', CASE WHEN S1 > 0 THEN 'S1' END, CASE WHEN S3 > 0 THEN 'S3' END, CASE WHEN S4 > 0 THEN 'S4' END, CASE WHEN S5 > 0 THEN 'S5' END,
    CASE WHEN S7 > 0 THEN 'S7' END, CASE WHEN S8 > 0 THEN 'S8' END, CASE WHEN S9 > 0 THEN 'S9' END) AS signals_seen,
  (SELECT CAST(best AS VARCHAR) FROM s4_runs r WHERE r.account = s.account AND s.S4 > 0) AS zero_months
FROM signals s
""")
def _(spark, d):
    ev = signals.evidence(signals.signal_matrix(profiled(spark, d)))
    s4 = F.get(F.filter("evidence", lambda e: e["signal"] == "S4"), F.lit(0))
    return ev.select("account", F.size("evidence").alias("n_records"),
                     F.concat_ws(",", F.col("evidence.signal")).alias("signals_seen"),
                     s4["facts"]["zero_months"].alias("zero_months"))


# --- scoring ---------------------------------------------------------------

cte("signal_long", """
SELECT account, 'S1' AS signal, S1 AS v FROM signals UNION ALL SELECT account, 'S3', S3 FROM signals
UNION ALL SELECT account, 'S4', S4 FROM signals UNION ALL SELECT account, 'S5', S5 FROM signals
UNION ALL SELECT account, 'S7', S7 FROM signals UNION ALL SELECT account, 'S8', S8 FROM signals UNION ALL SELECT account, 'S9', S9 FROM signals
""")
cte("signal_rank", """
SELECT account, signal, v, (row_number() OVER (PARTITION BY signal ORDER BY round(v, 9), account) - 1) / greatest((SELECT count(*) FROM signals) - 1, 1)::DOUBLE AS rank_pct
FROM signal_long
""")
cte("consensus", """
SELECT account, coalesce(avg(rank_pct) FILTER (WHERE v > 0), 0) AS consensus, count(*) FILTER (WHERE v > 0) AS n_signals FROM signal_rank GROUP BY 1
""")
cte("ranking", """
SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, account) AS rank FROM (
  SELECT s.*, round(consensus, 9) AS score, n_signals, avg_kwh,
    CASE WHEN S4 > 0 OR S5 > 0 OR S8 > 0 OR S9 > 0 THEN greatest(coalesce(base_kwh - avg_kwh, 0), coalesce(expected_kwh - avg_kwh, 0), 0) ELSE 0 END AS recoverable_kwh
  FROM signals s JOIN consensus USING (account) JOIN averages USING (account) LEFT JOIN expected USING (peer_group))
""")


def canonical(df: DataFrame) -> DataFrame:
    """Signals at nine decimals, so that equal values tie in both engines."""
    return df.select(*[F.round(c, 9).alias(c) if c in signals.ALL_SIGNALS else F.col(c) for c in df.columns])


def ranking(spark, d, **kw) -> DataFrame:
    """Staged ranking of all customers by consensus."""
    table_ = signal_table(spark, d, kw.get("base"))
    scored = scoring.score_customers(table_, unsupervised=kw.get("unsupervised", False), columns=kw.get("columns"))
    return scored


@query("signal_rank_percentiles", "SELECT account, signal, round(v, 6) AS value, round(rank_pct, 9) AS rank_pct FROM signal_rank WHERE v > 0")
def _(spark, d):
    t = signal_table(spark, d)
    return rounded(scoring.signal_ranks(t), value=6, rank_pct=9)


@query("consensus_score", "SELECT account, round(consensus, 9) AS consensus, n_signals FROM consensus")
def _(spark, d):
    t = signal_table(spark, d)
    return rounded(scoring.consensus(t), consensus=9)


@query("customer_ranking", """
SELECT account, rank, round(score, 9) AS score, round(recoverable_kwh, 6) AS recoverable_kwh, n_signals FROM ranking
""")
def _(spark, d):
    return rounded(ranking(spark, d).select("account", "rank", "score", "recoverable_kwh", "n_signals"), score=9, recoverable_kwh=6)


@query("recoverable_global", """
WITH m AS (SELECT quantile_cont(avg_kwh, 0.5) AS med FROM averages WHERE avg_kwh > 0)
SELECT account, round(CASE WHEN S4 > 0 OR S5 > 0 OR S8 > 0 OR S9 > 0 THEN greatest(med - avg_kwh, 0) ELSE 0 END, 6) AS recoverable_kwh
FROM signals JOIN averages USING (account) CROSS JOIN m
""")
def _(spark, d):
    df = scoring.recoverable_energy(signal_table(spark, d), segmented=False)
    return rounded(df.select("account", "recoverable_kwh"), recoverable_kwh=6)


@query("ranking_reasons", """
WITH r(signal, ord, text) AS (VALUES ('S1', 1, 'Caída y recuperación de consumo (patrón de manipulación temporal)'), ('S3', 2, 'Ruptura de nivel de consumo sin causa comercial'),
  ('S4', 3, 'Consumo en cero con servicio activo'), ('S5', 4, 'Consumo muy por debajo de su grupo par (misma ruta/clase)'),
  ('S7', 5, 'Consumo anómalamente plano (posible consumo fijo declarado)'), ('S8', 6, 'Consumo muy por debajo de sus vecinos del mismo transformador'),
  ('S9', 7, 'Consumo muy por debajo de su propio nivel histórico habitual')),
o AS (SELECT account, text, row_number() OVER (PARTITION BY account ORDER BY round(v, 9) DESC, ord DESC) AS rn FROM signal_long JOIN r USING (signal) WHERE v > 0)
SELECT s.account, coalesce(string_agg(text, ' | ' ORDER BY rn), '') AS reasons FROM signals s LEFT JOIN o ON o.account = s.account AND rn <= 3 GROUP BY 1
""")
def _(spark, d):
    df = scoring.reasons(canonical(signals.signal_matrix(profiled(spark, d))))
    return df.select("account", F.concat_ws(" | ", "reasons").alias("reasons"))


@query("suspect_count", """
WITH t AS (SELECT quantile_cont(score, 0.95) AS threshold FROM ranking)
SELECT round(threshold, 9) AS threshold, count(*) AS customers, CAST(sum(CASE WHEN score >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS suspects FROM ranking, t GROUP BY threshold
""")
def _(spark, d):
    r = stage(ranking(spark, d).select("account", "score"), "ranking")
    return rounded(scoring.suspects(r), threshold=9)


@query("ranking_by_class", """
SELECT consumption_class, count(*) AS customers, count(*) FILTER (WHERE n_signals > 0) AS suspects, round(sum(recoverable_kwh), 4) AS recoverable_kwh,
  round(avg(score), 6) AS mean_score FROM ranking GROUP BY 1
""")
def _(spark, d):
    return rounded(scoring.ranking_by_class(ranking(spark, d)), recoverable_kwh=4, mean_score=6)


@query("yield_per_visit", """
WITH o AS (SELECT consumption_class, score, recoverable_kwh, row_number() OVER (PARTITION BY consumption_class ORDER BY round(score, 9) DESC, account) AS pos,
  count(*) OVER (PARTITION BY consumption_class) AS customers FROM ranking),
v AS (SELECT *, CAST(greatest(1, round_even(customers * 5 / 100.0::DOUBLE, 0)) AS BIGINT) AS visits FROM o)
SELECT consumption_class, customers, visits, round(sum(recoverable_kwh) FILTER (WHERE pos <= visits), 4) AS top_kwh,
  round(avg(score) FILTER (WHERE pos <= visits), 6) AS mean_score_top, round(sum(recoverable_kwh), 4) AS total_kwh,
  round(sum(recoverable_kwh) FILTER (WHERE pos <= visits) / visits, 4) AS kwh_per_visit FROM v GROUP BY consumption_class, customers, visits
""")
def _(spark, d):
    r = stage(ranking(spark, d).select("account", "consumption_class", "score", "recoverable_kwh"), "ranking")
    return rounded(peers.yield_per_visit(r), top_kwh=4, mean_score_top=6, total_kwh=4, kwh_per_visit=4)


@query("energy_concentration", """
SELECT round(a, 4) AS pct_customers_non_residential, round(b, 4) AS pct_recoverable_non_residential, b > a * 1.5 AS dedicated_crew FROM (
  SELECT avg(CASE WHEN consumption_class <> 'RESIDENCIAL' THEN 1.0 ELSE 0.0 END) * 100 AS a,
    sum(CASE WHEN consumption_class <> 'RESIDENCIAL' THEN recoverable_kwh ELSE 0 END) / sum(recoverable_kwh) * 100 AS b FROM ranking)
""")
def _(spark, d):
    return rounded(peers.concentration(ranking(spark, d)), pct_customers_non_residential=4, pct_recoverable_non_residential=4)


@query("large_customers", """
SELECT account, round(score, 9) AS score, round(recoverable_kwh, 6) AS recoverable_kwh, 'Verificación individual de medición y contraste de demanda' AS action
FROM ranking WHERE is_large AND score >= 0 AND (n_signals > 0 OR recoverable_kwh > 0) ORDER BY recoverable_kwh DESC, score DESC, account LIMIT 25
""")
def _(spark, d):
    out = peers.large_customers(ranking(spark, d)).select("account", "score", "recoverable_kwh", "action")
    return rounded(out, score=9, recoverable_kwh=6)


@query("top_suspects", """
SELECT account, rank, round(score, 9) AS score, consumption_class, peer_level, round(recoverable_kwh, 6) AS recoverable_kwh FROM ranking WHERE rank <= 20
""")
def _(spark, d):
    r = ranking(spark, d).where(F.col("rank") <= 20)
    return rounded(r.select("account", "rank", "score", "consumption_class", "peer_level", "recoverable_kwh"), score=9, recoverable_kwh=6)


@query("unsupervised_ranking")
def _(spark, d):
    return rounded(ranking(spark, d, unsupervised=True).select("account", "rank", "score", "consensus", "unsupervised"), score=9)


@query("multilevel_risk", """
WITH sr AS (SELECT site, avg(score) AS site_risk FROM ranking GROUP BY 1),
zc AS (SELECT feeder AS zone, CAST(30 + 5 * (CAST(substr(feeder, 2) AS INTEGER) % 15) AS DOUBLE) AS zone_confidence FROM ranking WHERE feeder <> 'F003' GROUP BY 1),
p AS (SELECT quantile_cont(score, 0.8) AS p80 FROM ranking),
j AS (SELECT account, score, coalesce(site_risk, 0) AS site_risk, coalesce(zone_confidence, 100) AS zone_confidence, p80
  FROM ranking LEFT JOIN sr USING (site) LEFT JOIN zc ON zone = feeder CROSS JOIN p),
b AS (SELECT *, (0.65 * score + 0.35 * site_risk) * CASE WHEN zone_confidence < 50 THEN zone_confidence / 100 ELSE 1 END AS risk FROM j)
SELECT account, round(risk, 6) AS risk_score, zone_confidence < 50 AND score > p80 AS data_problem,
  row_number() OVER (ORDER BY round(risk, 12) DESC, account) AS risk_rank FROM b
""")
def _(spark, d):
    r = stage(ranking(spark, d).select("account", "score", "site", F.col("feeder").alias("zone")), "ranking")
    site_risk = r.groupBy("site").agg(F.avg("score").alias("site_risk"))
    zones = r.where(F.col("zone") != "F003").groupBy("zone").agg(
        (30 + 5 * (F.substring(F.min("zone"), 2, 9).cast("int") % 15)).cast("double").alias("zone_confidence"))
    return rounded(scoring.multilevel_risk(r, site_risk, zones), risk_score=6).select(
        "account", "risk_score", "data_problem", "risk_rank")


@query("ranking_with_unit", """
SELECT account, rank, coalesce(r_name, '') AS unit FROM ranking JOIN (SELECT c_custkey AS account, c_nationkey FROM customer) USING (account)
LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey <> 4 LEFT JOIN region ON r_regionkey = n_regionkey
""")
def _(spark, d):
    from wattledger.registry.inputs import hierarchy

    r = ranking(spark, d).select("account", "rank", "feeder")
    return scoring.with_unit(r, hierarchy(spark, d).where(F.col("feeder") != "F004")).select("account", "rank", "unit")
