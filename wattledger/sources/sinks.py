"""Sinks: result files, tables, exports and the run record."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flatten_for_text(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for formats without nesting."""
    return df.select(*[
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name)
        for f in df.schema.fields])


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    if fmt == "csv":
        flatten_for_text(df).write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def write_table(df: DataFrame, table: str, *, replace: bool = True) -> None:
    df.write.mode("overwrite" if replace else "append").saveAsTable(table)


def export_tables(tables: Mapping[str, DataFrame], folder: str) -> list[str]:
    """One CSV folder per non-empty table."""
    written = []
    for name, df in tables.items():
        if df.limit(1).count():
            write_result(df, f"{folder}/{name}", "csv")
            written.append(name)
    return written


def config_hash(config: Mapping) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def run_record(spark: SparkSession, run_id: str, config: Mapping, metrics: Mapping, started: datetime) -> DataFrame:
    """One-row run record, to be appended to the run table."""
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    row = (run_id, started, now, config_hash(config), json.dumps(dict(metrics), sort_keys=True, default=str))
    return spark.createDataFrame([row], "run_id string, started timestamp, finished timestamp, config_hash string, metrics string")
