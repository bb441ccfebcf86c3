"""The driver's tables seen as the domain's inputs, in Spark and in SQL."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger.functions.classify import classify_distinct, segment_columns
from wattledger.operators.peers import assign_peer_group
from wattledger.operators.series import account_series, month_axis, series_statistics, with_all_accounts
from wattledger.registry.core import cte
from wattledger.staging import stage

#: Months of the axis.
MONTHS = 36
#: Where the axis ends if there are no orders at all.
NO_ORDERS = date(2000, 1, 1)

# Tariff text of each market segment.
TARIFFS = {
    "HOUSEHOLD": "RESIDENCIAL BAJA TENSION",
    "BUILDING": "RESIDENCIAL DIGNIDAD",
    "FURNITURE": "COMERCIAL SIN DEMANDA",
    "AUTOMOBILE": "COMERCIAL CON DEMANDA MEDIA TENSION",
    "MACHINERY": "INDUSTRIAL CON DEMANDA MEDIA TENSION",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def code(prefix: str, number: Column, width: int = 3) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def register(spark: SparkSession, d: str) -> DataFrame:
    """Customer register from ``customer``: one row per account."""
    k = F.col("c_custkey")
    tariff = None
    for seg, text in TARIFFS.items():
        hit = F.col("c_mktsegment") == seg
        tariff = F.when(hit, F.lit(text)) if tariff is None else tariff.when(hit, F.lit(text))
    return table(spark, d, "customer").select(
        k.alias("account"),
        F.col("c_name").alias("name"),
        tariff.alias("tariff"),
        F.col("c_nationkey").alias("nation"),
        code("F", F.col("c_nationkey")).alias("feeder"),
        F.concat(code("F", F.col("c_nationkey")), F.lit("-R"), (k % 2).cast("string")).alias("route"),
        (F.lit(1) + (k % 3)).cast("int").alias("phases"),
        (k % 10 != 7).alias("active"),
        (F.abs("c_acctbal") / 1000).alias("p_prev_kw"),
        (F.abs("c_acctbal") / 4000).alias("q_prev_kvar"),
        (F.col("c_nationkey") % 5).cast("string").alias("division"),
        code("T", F.floor(k / 15), 6).alias("site"),
        (F.lit(600000) + (k * 7919) % 20000).cast("double").alias("x"),
        (F.lit(9700000) + (k * 10473) % 20000).cast("double").alias("y"),
    )


cte("register", """
SELECT c_custkey AS account, c_name AS name,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'RESIDENCIAL BAJA TENSION'
    WHEN 'BUILDING' THEN 'RESIDENCIAL DIGNIDAD' WHEN 'FURNITURE' THEN 'COMERCIAL SIN DEMANDA'
    WHEN 'AUTOMOBILE' THEN 'COMERCIAL CON DEMANDA MEDIA TENSION'
    WHEN 'MACHINERY' THEN 'INDUSTRIAL CON DEMANDA MEDIA TENSION' END AS tariff,
  c_nationkey AS nation, 'F' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS feeder,
  'F' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || '-R' || CAST(c_custkey % 2 AS VARCHAR) AS route,
  CAST(1 + c_custkey % 3 AS INTEGER) AS phases, c_custkey % 10 <> 7 AS active,
  abs(c_acctbal) / 1000 AS p_prev_kw, abs(c_acctbal) / 4000 AS q_prev_kvar,
  CAST(c_nationkey % 5 AS VARCHAR) AS division,
  'T' || lpad(CAST(c_custkey // 15 AS VARCHAR), 6, '0') AS site,
  CAST(600000 + (c_custkey * 7919) % 20000 AS DOUBLE) AS x,
  CAST(9700000 + (c_custkey * 10473) % 20000 AS DOUBLE) AS y
FROM customer
""")


def last_month(spark: SparkSession, d: str) -> date:
    """The last month that the dates of ``orders`` fill to its last day; a month in progress is left out."""
    day = table(spark, d, "orders").agg(F.max("o_orderdate").cast("date")).first()[0]
    if day is None:
        return NO_ORDERS
    return (((day + timedelta(days=1)).replace(day=1)) - timedelta(days=1)).replace(day=1)


cte("axis_end", """
SELECT CAST(date_trunc('month', CAST(max(o_orderdate) AS DATE) + 1) - INTERVAL 1 MONTH AS DATE) AS final_month FROM orders
""")


def monthly_orders(spark: SparkSession, d: str, last: date) -> DataFrame:
    """Long readings of the axis from ``orders``: kWh per account and month, months without orders absent.

    The range is put on the raw date, so that it reaches the Parquet scan.
    """
    first = month_axis(last, MONTHS)[0]
    end = (last + timedelta(days=31)).replace(day=1)
    day = F.col("o_orderdate")
    return (
        table(spark, d, "orders")
        .where((day >= F.lit(first).cast("timestamp_ntz")) & (day < F.lit(end).cast("timestamp_ntz")))
        .groupBy(
            F.col("o_custkey").alias("account"),
            F.trunc("o_orderdate", "month").alias("period"),
        )
        .agg(F.floor(F.round(F.sum("o_totalprice"), 2) / 100).cast("double").alias("kwh"))
    )


cte("monthly", """
SELECT o_custkey AS account, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
  CAST(floor(round(sum(o_totalprice), 2) / 100) AS DOUBLE) AS kwh
FROM orders GROUP BY 1, 2
""")


def customer_series(spark: SparkSession, d: str, last: date | None = None) -> DataFrame:
    """Register rows with their 36-month array, up to ``last`` or the last whole month, and its statistics.

    Readings are whole kWh. A month without orders is a zero reading for every third account and a
    missing one for the others.
    """
    last = last or last_month(spark, d)
    series = with_all_accounts(register(spark, d), account_series(monthly_orders(spark, d, last), last, MONTHS), MONTHS)
    return series_statistics(series.withColumn(
        "series", F.when(F.col("account") % 3 == 0, F.transform("series", lambda x: F.coalesce(x, F.lit(0.0)))).otherwise(F.col("series"))))


cte("axis", """
SELECT CAST(i AS INTEGER) AS i, CAST(final_month - to_months(CAST(35 - i AS INTEGER)) AS DATE) AS period
FROM range(36) t(i) CROSS JOIN axis_end
""")
cte("seen_accounts", """
SELECT account FROM register
""")
cte("readings", """
SELECT s.account, a.i, a.period,
  CASE WHEN m.kwh IS NULL AND s.account % 3 = 0 THEN 0.0 ELSE m.kwh END AS kwh
FROM seen_accounts s CROSS JOIN axis a
LEFT JOIN monthly m ON m.account = s.account AND m.period = a.period
""")
cte("finite", """
SELECT account, i, period, kwh,
  row_number() OVER (PARTITION BY account ORDER BY i) - 1 AS pos,
  count(*) OVER (PARTITION BY account) AS n
FROM readings WHERE kwh IS NOT NULL
""")
cte("stats", """
SELECT account, avg(kwh) AS mean_kwh, quantile_cont(kwh, 0.75) AS base_kwh FROM readings GROUP BY account
""")


def segmented(spark: SparkSession, d: str) -> DataFrame:
    return segment_columns(classify_distinct(customer_series(spark, d)))


def peer_customers(spark: SparkSession, d: str) -> DataFrame:
    return assign_peer_group(stage(segmented(spark, d), "segmented"))


CLASS_CASE = """
  CASE WHEN regexp_matches(trim(tariff), 'ALUMBRADO|A\\.?\\s*P\\.?\\b|LUMINARIA|SEMAFORO|SEM[ÁA]FORO', 'i') THEN 'ALUMBRADO_PUBLICO'
    WHEN regexp_matches(trim(tariff), 'BOMBEO|AGUA\\s+POTABLE', 'i') THEN 'BOMBEO_AGUA'
    WHEN regexp_matches(trim(tariff), 'ASISTENCIA\\s+SOCIAL|BENEFICIO\\s+P[ÚU]BLICO|CULTO|IGLESIA|ESCENARIO[S]?\\s+DEPORTIVO', 'i') THEN 'ASISTENCIA_SOCIAL'
    WHEN regexp_matches(trim(tariff), 'OFICIAL|ENTIDAD(ES)?\\s+P[ÚU]BLICA|GUBERNAMENTAL|MUNICIP', 'i') THEN 'OFICIAL'
    WHEN regexp_matches(trim(tariff), 'INDUSTRIAL|ARTESANAL|MANUFACTUR', 'i') THEN 'INDUSTRIAL'
    WHEN regexp_matches(trim(tariff), 'COMERCIAL|GENERAL|NEGOCIO', 'i') THEN 'COMERCIAL'
    WHEN regexp_matches(trim(tariff), 'RESIDENCIAL|DOMICILIAR|DIGNIDAD|VIVIENDA|DOM[ÉE]STIC', 'i') THEN 'RESIDENCIAL'
    ELSE 'NO_CLASIFICADO' END"""
VOLTAGE_CASE = """
  CASE WHEN regexp_matches(tariff, 'ALTA\\s+TENSI[ÓO]N|\\bAT\\b|ALTO\\s+VOLTAJE', 'i') THEN 'AT'
    WHEN regexp_matches(tariff, 'MEDIA\\s+TENSI[ÓO]N|\\bMT\\b|MEDIO\\s+VOLTAJE', 'i') THEN 'MT'
    WHEN regexp_matches(tariff, 'BAJA\\s+TENSI[ÓO]N|\\bBT\\b|BAJO\\s+VOLTAJE', 'i') THEN 'BT'
    ELSE 'DESCONOCIDO' END"""
DEMAND_CASE = """
  CASE WHEN regexp_matches(tariff, 'SIN\\s+DEMANDA', 'i') THEN false
    WHEN regexp_matches(tariff, 'CON\\s+DEMANDA', 'i') THEN true END"""


def stratum_case(kwh: str, cls: str) -> str:
    res = [50, 100, 130, 200, 300, 500, 1000]
    oth = [200, 1000, 5000, 20000, 100000]
    def ladder(cuts: list[int]) -> str:
        low, out = 0, f"CASE WHEN {kwh} IS NULL THEN 'E00_SIN_DATO' "
        for i, c in enumerate(cuts, 1):
            out += f"WHEN {kwh} <= {c} THEN 'E{i:02d}_{low}-{c}' "
            low = c
        return out + f"ELSE 'E{len(cuts) + 1:02d}_{low}+' END"
    return f"CASE WHEN {cls} = 'RESIDENCIAL' THEN {ladder(res)} ELSE {ladder(oth)} END"


cte("classified", f"""
SELECT *, {CLASS_CASE} AS consumption_class, {VOLTAGE_CASE} AS voltage_level, {DEMAND_CASE} AS with_demand
FROM register JOIN stats USING (account)
""")
cte("segmented", f"""
SELECT *, consumption_class || '|' || voltage_level || '|' || stratum AS segment,
  coalesce(base_kwh, 0) >= 5000 OR voltage_level IN ('MT', 'AT') AS is_large,
  consumption_class IN ('RESIDENCIAL', 'COMERCIAL') AS peer_eligible
FROM (SELECT *, {stratum_case('base_kwh', 'consumption_class')} AS stratum FROM classified)
""")
cte("peer_1", """
SELECT *, count(*) OVER (PARTITION BY consumption_class, voltage_level, phases, route) AS c1 FROM segmented
""")
cte("peer_2", """
SELECT *, count(*) OVER (PARTITION BY consumption_class, voltage_level, route) AS c2 FROM peer_1 WHERE c1 < 8
""")
cte("peer_3", """
SELECT *, count(*) OVER (PARTITION BY consumption_class, voltage_level, phases) AS c3 FROM peer_2 WHERE c2 < 8
""")
cte("peer_4", """
SELECT *, count(*) OVER (PARTITION BY consumption_class, voltage_level) AS c4 FROM peer_3 WHERE c3 < 8
""")
cte("peer_5", """
SELECT *, count(*) OVER (PARTITION BY consumption_class) AS c5 FROM peer_4 WHERE c4 < 8
""")
cte("placed", """
SELECT account, 'CLASE_TENSION_FASES_RUTA::' || consumption_class || '|' || voltage_level || '|' || phases || '|' || route AS peer_group,
  'CLASE_TENSION_FASES_RUTA' AS peer_level, 1.00::DOUBLE AS peer_confidence, c1 AS peer_n FROM peer_1 WHERE c1 >= 8
UNION ALL SELECT account, 'CLASE_TENSION_RUTA::' || consumption_class || '|' || voltage_level || '|' || route,
  'CLASE_TENSION_RUTA', 0.90, c2 FROM peer_2 WHERE c2 >= 8
UNION ALL SELECT account, 'CLASE_TENSION_FASES::' || consumption_class || '|' || voltage_level || '|' || phases,
  'CLASE_TENSION_FASES', 0.70, c3 FROM peer_3 WHERE c3 >= 8
UNION ALL SELECT account, 'CLASE_TENSION::' || consumption_class || '|' || voltage_level,
  'CLASE_TENSION', 0.60, c4 FROM peer_4 WHERE c4 >= 8
UNION ALL SELECT account, 'CLASE::' || consumption_class, 'CLASE', 0.40, c5 FROM peer_5 WHERE c5 >= 8
UNION ALL SELECT account, NULL, NULL, 0.0, 0 FROM peer_5 WHERE c5 < 8
""")
cte("peered", """
SELECT * FROM segmented JOIN placed USING (account)
""")


def head_energy(spark: SparkSession, d: str) -> DataFrame:
    """Feeder-head energy: ``orders`` summed by nation and month."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    # Orders are first summed per account and month, so the join carries the small side.
    per_account = o.groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("period")).agg(
        F.sum("o_totalprice").alias("v")
    )
    return (
        per_account.join(c, per_account.o_custkey == c.c_custkey)
        .groupBy(code("F", F.col("c_nationkey")).alias("feeder"), "period")
        .agg(F.floor(F.round(F.sum("v"), 2) / 100).cast("double").alias("kwh"))
        .where(F.col("period") <= F.lit(last_month(spark, d)))
    )


cte("head_energy", """
SELECT 'F' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS feeder,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(floor(round(sum(o_totalprice), 2) / 100) AS DOUBLE) AS kwh
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY 1, 2 HAVING CAST(date_trunc('month', o_orderdate) AS DATE) <= (SELECT final_month FROM axis_end)
""")


def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Feeder, substation and business unit from ``nation`` and ``region``."""
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        code("F", F.col("n_nationkey")).alias("feeder"),
        F.concat(F.lit("S"), F.floor(F.col("n_nationkey") / 3).cast("string")).alias("substation"),
        F.col("r_name").alias("unit"),
    )


cte("hierarchy", """
SELECT 'F' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS feeder,
  'S' || CAST(n_nationkey // 3 AS VARCHAR) AS substation, r_name AS unit
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
