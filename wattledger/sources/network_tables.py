"""Network tables with their defaults filled, and nested feeder models to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions.parse import unit_capacities


def _number(df: DataFrame, name: str, default: float, kind: str = "double") -> Column:
    """Column as a number; missing, unreadable and zero take the default."""
    if name not in df.columns:
        return F.lit(default).cast(kind)
    return F.coalesce(F.nullif(F.col(name).cast("string").try_cast("double"), F.lit(0.0)), F.lit(float(default))).cast(kind)


def _text(df: DataFrame, name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in df.columns else F.lit(default)


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in df.columns else F.lit(False)


def segments(df: DataFrame) -> DataFrame:
    return df.select(
        _text(df, "feeder").alias("feeder"), _text(df, "segment_id").alias("segment_id"), _text(df, "from_node").alias("from_node"),
        _text(df, "to_node").alias("to_node"), _text(df, "conductor").alias("conductor"), _number(df, "length_km", 0.0).alias("length_km"),
        _number(df, "n_phases", 3, "int").alias("n_phases"), _number(df, "voltage_v", 13800.0).alias("voltage_v"), _flag(df, "is_lv").alias("is_lv"))


def sites(df: DataFrame) -> DataFrame:
    """Declared kVA else the first unit; units else the declared kVA."""
    units = unit_capacities(F.col("kvas").cast("string")) if "kvas" in df.columns else F.array().cast("array<double>")
    kva = F.coalesce(F.col("kva").cast("string").try_cast("double") if "kva" in df.columns else F.lit(None), F.get("__u", F.lit(0)))
    return df.withColumn("__u", F.coalesce(units, F.array().cast("array<double>"))).select(
        _text(df, "feeder").alias("feeder"), _text(df, "node").alias("node"), _text(df, "site").alias("site"), kva.alias("kva"),
        F.when(F.size("__u") > 0, F.col("__u")).when(F.coalesce(kva, F.lit(0.0)) != 0, F.array(kva)).otherwise(F.array().cast("array<double>")).alias("kvas"),
        _text(df, "config", "UNIDAD_SIMPLE").alias("config"), _number(df, "phases", 3, "int").alias("phases"))


def customers(df: DataFrame) -> DataFrame:
    return df.select(
        _text(df, "feeder").alias("feeder"), _text(df, "node").alias("node"), _text(df, "account").alias("account"),
        _number(df, "energy_kwh", 0.0).alias("energy_kwh"), _number(df, "phase", 1, "int").alias("phase"), _text(df, "tariff").alias("tariff"),
        _text(df, "meter_type", "_default").alias("meter_type"), _flag(df, "totaliser").alias("totaliser"), _flag(df, "under_totaliser").alias("under_totaliser"))


def lights(df: DataFrame) -> DataFrame:
    return df.select(
        _text(df, "feeder").alias("feeder"), _text(df, "node").alias("node"), _text(df, "light").alias("light"), _number(df, "lamp_w", 0.0).alias("lamp_w"),
        _text(df, "technology", "_default").alias("technology"), _number(df, "hours", 12.0).alias("hours"), _number(df, "days", 30.0).alias("days"),
        _flag(df, "metered").alias("metered"), _flag(df, "traffic").alias("traffic"))


def flatten(models: DataFrame, element: str) -> DataFrame:
    """One element class of nested feeder models: a row per entry of the array ``element``."""
    return models.select("feeder", F.inline(element))

