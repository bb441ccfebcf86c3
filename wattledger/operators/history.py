"""Snapshots of balances by period, level and entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["period", "level", "entity"]


def upsert(history: DataFrame, snapshot: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Replace the rows of ``history`` whose key is in ``snapshot``, keep the rest."""
    kept = history.join(snapshot.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(snapshot, allowMissingColumns=True)


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """Store a period: only its own partitions are overwritten, nothing else is read."""
    snapshot.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "level").parquet(path)


def entity_series(history: DataFrame, entity: str, level: str | None = None, metric: str = "ntl_pct") -> DataFrame:
    rows = history.where(F.col("entity") == entity)
    if level:
        rows = rows.where(F.col("level") == level)
    return rows.select("period", metric, "balance_type", "coverage_pct", "config_hash").orderBy("period")


def compare_periods(history: DataFrame, a: str, b: str, level: str) -> DataFrame:
    """Change between two periods per entity, and whether it is comparable at all."""
    cols = ["ntl_pct", "ntl_kwh", "balance_type", "config_hash"]
    side = lambda period, tag: history.where((F.col("period") == period) & (F.col("level") == level)).select(
        "entity", *[F.col(c).alias(f"{c}_{tag}") for c in cols])
    delta = F.round(F.col("ntl_pct_b") - F.col("ntl_pct_a"), 2)
    return side(a, "a").join(side(b, "b"), "entity").select(
        "entity", "ntl_pct_a", "ntl_pct_b", delta.alias("delta_ntl_pct"),
        F.bround(F.col("ntl_kwh_b") - F.col("ntl_kwh_a"), 0).alias("delta_ntl_kwh"),
        F.when(delta < -0.5, "MEJORA").when(delta > 0.5, "EMPEORA").otherwise("ESTABLE").alias("trend"),
        (F.col("config_hash_a") == F.col("config_hash_b")).alias("comparable"),
        "balance_type_a", "balance_type_b",
    )


def warnings(history: DataFrame) -> DataFrame:
    """Counts behind the three warnings: mixed settings, estimates, low coverage."""
    return history.agg(
        F.count_distinct("config_hash").alias("settings"),
        F.count_if(F.col("balance_type").isin("INDICATIVO", "PARCIAL")).alias("not_measured"),
        F.count_if(F.coalesce(F.col("coverage_pct"), F.lit(100.0)) < 90).alias("low_coverage"),
    ).withColumn("mixed_settings", F.col("settings") > 1)
