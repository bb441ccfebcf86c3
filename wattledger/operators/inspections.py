"""What the crews found: extraction, registry and campaign results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdict of each finding of the field form.
VERDICTS = {
    "CONEXION_DIRECTA": "CONFIRMADO", "MEDIDOR_MANIPULADO": "CONFIRMADO", "PUENTE_EN_ACOMETIDA": "CONFIRMADO",
    "SELLOS_VIOLENTADOS": "CONFIRMADO", "MEDIDOR_INVERTIDO": "CONFIRMADO", "MEDIDOR_FRENADO": "CONFIRMADO",
    "SIN_NOVEDAD": "DESCARTADO", "PREDIO_CERRADO": "NO_CONCLUYENTE", "ACCESO_NEGADO": "NO_CONCLUYENTE",
    "CLIENTE_NO_EXISTE": "PROBLEMA_DATOS", "ERROR_DE_DATOS": "PROBLEMA_DATOS",
}
REGISTRY_KEY = ["account", "work_order", "inspected_on"]


def verdict(finding: Column) -> Column:
    """Verdict of a finding; one that is not listed is inconclusive, never assumed good."""
    table = F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, finding), F.lit("NO_CONCLUYENTE"))


def extract_inspections(field: DataFrame, batch_date: Column | None = None) -> DataFrame:
    """Visited rows with a finding. A customer that was not visited is not a result."""
    visited = F.lower(F.trim(F.col("inspected").cast("string"))).isin("1", "true", "sí", "si", "t")
    finding = F.upper(F.trim("finding"))
    account = F.trim(F.col("account").cast("string"))
    day = F.col("inspected_on").try_cast("date")
    if batch_date is not None:
        day = F.coalesce(day, batch_date)
    return field.where(visited & F.col("finding").isNotNull() & (F.trim("finding") != "") & (account != "")).select(
        account.alias("account"), finding.alias("finding"), verdict(finding).alias("verdict"), day.alias("inspected_on"),
        F.coalesce(F.col("work_order").cast("string"), F.lit("")).alias("work_order"),
        F.coalesce(F.col("technician").cast("string"), F.lit("")).alias("technician"),
        F.col("meter_reading").try_cast("double").alias("meter_reading"),
    )


def upsert_registry(registry: DataFrame | None, incoming: DataFrame, *, order: str = "loaded_at") -> DataFrame:
    """Union, keeping the last row of each (account, order, date); reloading a batch changes nothing.

    ``max_by`` combines on the map side, so a heavily repeated key is reduced first.
    """
    rows = incoming if registry is None else registry.unionByName(incoming, allowMissingColumns=True)
    payload = [c for c in rows.columns if c not in REGISTRY_KEY]
    return rows.groupBy(*REGISTRY_KEY).agg(
        F.max_by(F.struct(*payload), F.struct(order, "finding")).alias("__r")).select(*REGISTRY_KEY, "__r.*")


def confirmed_base(registry: DataFrame, inherited: DataFrame | None = None) -> DataFrame:
    """Own confirmed cases joined with the inherited base; one row per account and date."""
    own = registry.where(F.col("verdict") == "CONFIRMADO").select(
        F.col("account").cast("string").alias("account"), F.col("inspected_on").alias("date"),
        F.col("finding").alias("kind"), F.lit("CAMPO").alias("origin"))
    rows = own.withColumn("__o", F.lit(1))
    if inherited is not None:
        rows = rows.unionByName(inherited.select(
            F.col("account").cast("string").alias("account"), "date", "kind", F.lit("HISTORICO").alias("origin"), F.lit(0).alias("__o")))
    # The inherited row comes first in the union and wins.
    return rows.groupBy("account", "date").agg(
        F.min_by(F.struct("kind", "origin"), F.struct("__o", "kind")).alias("r")).select("account", "date", "r.*")


def verified_negatives(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("verdict") == "DESCARTADO").select("account").distinct()


def inconclusive(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("verdict") == "NO_CONCLUYENTE")


def campaign_summary(registry: DataFrame) -> DataFrame:
    v = F.col("verdict")
    g = registry.agg(
        F.count(F.lit(1)).alias("inspections"), F.count_if(v == "CONFIRMADO").alias("confirmed"),
        F.count_if(v == "DESCARTADO").alias("discarded"), F.count_if(v == "NO_CONCLUYENTE").alias("inconclusive"),
        F.count_if(v == "PROBLEMA_DATOS").alias("data_problems"))
    verified = F.col("confirmed") + F.col("discarded")
    pct = lambda a, b: F.coalesce(100.0 * a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return g.select(
        "*", F.round(pct(F.col("confirmed"), verified), 1).alias("precision_pct"),
        F.round(pct(verified, F.col("inspections")), 1).alias("coverage_pct"))


def yield_per_order(registry: DataFrame) -> DataFrame:
    v = F.col("verdict")
    g = registry.groupBy("work_order").agg(
        F.count(F.lit(1)).alias("visits"), F.count_if(v.isin("CONFIRMADO", "DESCARTADO")).alias("verified"),
        F.count_if(v == "CONFIRMADO").alias("confirmed"))
    return g.withColumn("precision_pct", F.round(100.0 * F.col("confirmed") / F.nullif("verified", F.lit(0)), 1))


def field_lift(registry: DataFrame, ranking: DataFrame, top_pct: float = 10.0) -> DataFrame:
    """Precision of verified visits inside and outside the top of the ranking, and the lift."""
    n = ranking.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(top_pct) / 100.0)).alias("__cut"))  # one row
    seen = registry.where(F.col("verdict").isin("CONFIRMADO", "DESCARTADO")).select(
        F.col("account").cast("string").alias("__a"), (F.col("verdict") == "CONFIRMADO").cast("double").alias("theft"))
    ranks = ranking.select(F.col("account").cast("string").alias("__a"), "rank")
    marked = seen.join(ranks, "__a", "left").crossJoin(F.broadcast(n)).withColumn(
        "top", F.coalesce(F.col("rank") <= F.col("__cut"), F.lit(False)))
    rate = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("theft"))), F.lit(0.0))
    g = marked.agg(
        F.count(F.lit(1)).alias("verified"), F.count_if("top").alias("in_top"), rate(F.col("top")).alias("__t"),
        rate(~F.col("top")).alias("__r"), F.avg("theft").alias("__b"))
    return g.select(
        "verified", "in_top", (100 * F.col("__t")).alias("precision_top_pct"), (100 * F.col("__r")).alias("precision_rest_pct"),
        F.coalesce(F.col("__t") / F.nullif("__b", F.lit(0.0)), F.lit(0.0)).alias("field_lift"))
