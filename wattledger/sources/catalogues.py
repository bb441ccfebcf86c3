"""Catalogue tables and head-energy loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def head_totals(head: DataFrame) -> DataFrame:
    """Head energy summed over the periods per feeder; mandatory columns are checked."""
    missing = [c for c in ("feeder", "kwh") if c not in head.columns]
    if missing:
        raise ValueError(f"head energy lacks columns {missing}")
    return head.groupBy("feeder").agg(F.sum("kwh").alias("kwh"), F.count(F.lit(1)).alias("periods"))


def merge_catalogue(explicit: DataFrame, derived: DataFrame, key: str = "code") -> DataFrame:
    """Union of two catalogues in which an explicit entry wins over a derived one.

    Values missing in the explicit entry are not filled: the maker's row is taken
    whole.
    """
    cols = [c for c in explicit.columns if c in derived.columns]
    only_derived = derived.select(*cols).join(explicit.select(key).distinct(), key, "left_anti")
    return explicit.select(*cols).withColumn("origin", F.lit("CATALOGO")).unionByName(
        only_derived.withColumn("origin", F.lit("ESTIMADO_MODELO")))
