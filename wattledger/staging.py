"""Durable intermediate tables.

A stage is written as Parquet under ``spark.checkpoint.dir`` and read back. That
cuts the lineage, survives the loss of executors, and keeps column pruning and
statistics for whoever reads the stage several times. Values that depend on how
rows were partitioned (partition ids, see ``operators.ranking``) are only ever
computed on the way into a stage, so every later reader sees the same ones.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_STAGES: list[str] = []


def stage_root(spark: SparkSession) -> str:
    """Folder the session names for checkpoints; a temporary one if it names none and runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="wattledger-stages-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Materialise ``df`` once and return a DataFrame that reads the written table.

    The planner knows the size of the written files, so a join with a small stage
    is broadcast and one with a large stage is shuffled, without a hint.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/wattledger/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return sum(bool(p.getFileSystem(conf).delete(p, True)) for p in found)


def settle(spark: SparkSession, build: Callable[[], DataFrame], label: str = "result") -> DataFrame:
    """Stage what ``build`` returns, and delete the stages that it wrote on the way: nothing reads them any more.

    ``build`` must not hand out any of its own stages by another way than its result.
    """
    mark = len(_STAGES)
    out = stage(build(), label)
    inner = _STAGES[mark:-1]
    del _STAGES[mark:-1]
    _delete(spark, inner)
    return out


def drop_stages(spark: SparkSession) -> int:
    """Delete the stage tables this process wrote. Call when results are persisted."""
    paths = _STAGES[:]
    _STAGES.clear()
    return _delete(spark, paths)
