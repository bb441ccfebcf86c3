"""Sources, sinks, set operations and the streaming loads."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.operators import inspections, journal
from wattledger.registry.core import query
from wattledger.registry.customers import rounded
from wattledger.registry.evidence import field_rows
from wattledger.registry.field import changes
from wattledger.registry.inputs import code, table
from wattledger.sources import catalogues, readers, sinks
from wattledger.staging import stage, stage_root
from wattledger.streaming import ingest


def scratch(spark, label: str) -> str:
    """New folder under the shared checkpoint folder."""
    return f"{stage_root(spark)}/wattledger/{label}-{uuid.uuid4().hex}"


@query("delimited_scan", "SELECT CAST(c_custkey AS VARCHAR) AS CUENTACONTRATO, c_mktsegment AS DESTARI, replace(CAST(c_custkey * 1000 + 302 AS VARCHAR), '302', '.302') AS KWH_1 FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    path = scratch(spark, "csv")
    table(spark, d, "customer").select(
        k.cast("string").alias("CUENTACONTRATO"), F.col("c_mktsegment").alias("DESTARI"), F.col("c_name").alias("NOMBRE"),
        F.regexp_replace((k * 1000 + 302).cast("string"), "302", ".302").alias("KWH_1"),
    ).write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return readers.read_delimited(spark, path, columns=["CUENTACONTRATO", "DESTARI", "KWH_1"])


@query("parquet_scan", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark, d):
    return readers.read_parquet(spark, f"{d}/orders.parquet", columns=["o_orderkey", "o_custkey"])


@query("parameterised_sql", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' GROUP BY 1")
def _(spark, d):
    return readers.read_query(
        spark, "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} WHERE o_totalprice > :floor AND o_orderstatus = :status GROUP BY 1",
        {"floor": 100000.0, "status": "F"}, orders=table(spark, d, "orders"))


@query("labelled_sources", """
SELECT 'comercial' AS source, CAST(c_custkey AS BIGINT) AS code, c_name AS name, NULL AS balance FROM customer
UNION ALL SELECT 'sig', s_suppkey, s_name, s_acctbal FROM supplier
""")
def _(spark, d):
    out, _errors = readers.read_sources({
        "comercial": lambda: table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name")),
        "sig": lambda: table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        "ausente": lambda: spark.read.parquet(f"{d}/no_such_table.parquet"),
    })
    return out


@query("field_mapping", "SELECT c_custkey AS contract_account, c_name AS customer_name, CAST(NULL AS VARCHAR) AS tariff FROM customer")
def _(spark, d):
    return readers.map_fields(table(spark, d, "customer"), {"c_custkey": "contract_account", "c_name": "customer_name", "DESTARI": "tariff"})


@query("catalogue_merge", """
SELECT 'C' || p_partkey AS code, CAST(p_size AS DOUBLE) AS r_ohm_km, 'CATALOGO' AS origin FROM part WHERE p_size < 10
UNION ALL SELECT 'C' || p_partkey, p_retailprice / 1000, 'ESTIMADO_MODELO' FROM part WHERE p_size >= 10
""")
def _(spark, d):
    p = table(spark, d, "part")
    name = F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("code")
    return catalogues.merge_catalogue(
        p.where(F.col("p_size") < 10).select(name, F.col("p_size").cast("double").alias("r_ohm_km")),
        p.select(name, (F.col("p_retailprice") / 1000).alias("r_ohm_km")))


@query("result_sinks", """
SELECT 'csv' AS format, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer UNION ALL SELECT 'json', count(*), sum(c_custkey)::BIGINT FROM customer
UNION ALL SELECT 'parquet', count(*), sum(c_custkey)::BIGINT FROM customer
""")
def _(spark, d):
    df = table(spark, d, "customer").withColumn("tags", F.array("c_mktsegment", "c_name"))
    out = None
    for fmt in ("parquet", "csv", "json"):
        path = scratch(spark, f"sink-{fmt}")
        sinks.write_result(df, path, fmt)
        back = spark.read.option("header", True).format(fmt).load(path)
        g = back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c_custkey").cast("bigint")).alias("keys")).withColumn("format", F.lit(fmt))
        out = g if out is None else out.unionByName(g)
    return out


@query("folder_export", "SELECT count(*) AS n FROM customer")
def _(spark, d):
    folder = scratch(spark, "export")
    sinks.export_tables({"customer": table(spark, d, "customer"), "none": table(spark, d, "nation").limit(0)}, folder)
    return spark.read.option("header", True).csv(f"{folder}/customer").agg(F.count(F.lit(1)).alias("n"))


@query("table_sink", """
SELECT 'replaced' AS state, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer WHERE c_custkey % 3 = 1
UNION ALL SELECT 'appended', count(*), sum(c_custkey)::BIGINT FROM customer WHERE c_custkey % 3 > 0
""")
def _(spark, d):
    """A table is written, replaced and appended to, and read back after each."""
    name = f"sink_{uuid.uuid4().hex}"
    c = table(spark, d, "customer")
    part = lambda k: c.where(F.col("c_custkey") % 3 == k)
    read = lambda state: stage(spark.table(name).agg(F.lit(state).alias("state"), F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys")), state)
    try:
        sinks.write_table(part(0), name)
        sinks.write_table(part(1), name)
        replaced = read("replaced")
        sinks.write_table(part(2), name, replace=False)
        return replaced.unionByName(read("appended"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@query("run_log", """
SELECT 'R' || i AS run_id, substr(sha256('{"window": ' || 12 * i || '}'), 1, 16) AS config_hash, '{"customers": ' || (SELECT count(*) FROM customer) || '}' AS metrics FROM (SELECT unnest([1, 2]) AS i)
""")
def _(spark, d):
    n = table(spark, d, "customer").agg(F.count(F.lit(1))).first()[0]
    path = scratch(spark, "runs")
    for i in (1, 2):
        sinks.run_record(spark, f"R{i}", {"window": 12 * i}, {"customers": n}, datetime(2024, 1, i)).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("run_id", "config_hash", "metrics")


@query("semi_join_accounts", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, d):
    wanted = table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(wanted, "c_custkey", "left_semi")


@query("stream_journal", """
SELECT package, count(*) AS changes, min(seq) AS first_seq, max(seq) AS last_seq FROM (
  SELECT 'P' || (user_id % 10) AS package, event_id AS seq FROM events WHERE event_id % 4 <> 0) GROUP BY 1
""")
def _(spark, d):
    """The journal loaded as a stream, twice over the same file, and read back once per change."""
    raw = changes(spark, d).withColumn("at", F.col("at").cast("timestamp"))
    source = scratch(spark, "journal-in")
    raw.write.parquet(source)
    raw.where(F.col("seq") % 3 == 0).write.mode("append").parquet(source)        # a resubmitted part
    stream = journal.intake(spark.readStream.schema(raw.schema).parquet(source))
    target = scratch(spark, "journal-out")
    # The whole history is within reach of the watermark, so late resubmissions are recognised.
    q = ingest.append_batches(ingest.journal_stream(stream, event_time="at", lateness="365 days"), target, scratch(spark, "journal-state"))
    q.awaitTermination()
    return ingest.current_rows(spark, target, ["package", "seq"], ["at"]).groupBy("package").agg(
        F.count(F.lit(1)).alias("changes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("stream_inspections", "SELECT verdict, count(*) AS visits FROM registry_rows GROUP BY 1")
def _(spark, d):
    """The inspection registry fed by a stream: last row per account, order and date."""
    rows = field_rows(spark, d)
    source = scratch(spark, "visits-in")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    ready = inspections.extract_inspections(stream.withColumn(
        "technician", F.lpad(F.col("event_id").cast("string"), 12, "0")))
    target = scratch(spark, "visits-out")
    ingest.append_batches(ready, target, scratch(spark, "visits-state")).awaitTermination()
    return ingest.current_rows(spark, target, inspections.REGISTRY_KEY, ["technician"]).groupBy("verdict").agg(
        F.count(F.lit(1)).alias("visits"))
