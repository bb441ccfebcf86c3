"""Readers: delimited text, Parquet, relational tables, SQL, many sources at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _take(df: DataFrame, columns: Sequence[str] | None, limit: int | None) -> DataFrame:
    if columns:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        df = df.select(*columns)
    return df.limit(limit) if limit else df


def read_delimited(spark: SparkSession, path: str, *, columns: Sequence[str] | None = None, limit: int | None = None,
                   sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """Delimited text with every column as string; only the header line is read for the schema."""
    header = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    df = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("nullValue", "\x00").schema(schema).csv(path)
    return _take(df, columns, limit)


def read_parquet(spark: SparkSession, path: str, *, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    return _take(spark.read.parquet(path), columns, limit)


# JDBC address by kind of database.
JDBC_URLS = {
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database};encrypt=true",
    "postgres": "jdbc:postgresql://{host}:{port}/{database}",
    "oracle": "jdbc:oracle:thin:@//{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
}


def jdbc_options(kind: str, *, host: str, port: int, database: str, table: str, columns: Sequence[str] | None = None,
                 partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
                 sessions: int = 8, fetch_size: int = 50_000) -> dict[str, str]:
    """Reader options for a relational table.

    ``sessions`` caps the connections open on the source (``numPartitions``); with a
    partition column the table is read in that many ranges, and the driver fetches
    ``fetch_size`` rows at a time. Pruning and limits are pushed down by Spark.
    """
    if kind not in JDBC_URLS:
        raise ValueError(f"unknown database kind {kind!r}")
    for name in [table, *(columns or [])]:
        if not all(part.isidentifier() for part in name.split(".")):
            raise ValueError(f"bad identifier {name!r}")
    source = table if not columns else f"(SELECT {', '.join(columns)} FROM {table}) t"
    out = {"url": JDBC_URLS[kind].format(host=host, port=port, database=database), "dbtable": source, "fetchsize": str(fetch_size)}
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partition column needs its bounds")
        out |= {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(sessions)}
    return out


def read_relational(spark: SparkSession, kind: str, *, user: str | None = None, password: str | None = None,
                    limit: int | None = None, **where) -> DataFrame:
    reader = spark.read.format("jdbc").options(**jdbc_options(kind, **where))
    if user is not None:
        reader = reader.option("user", user).option("password", password or "")
    return _take(reader.load(), None, limit)


def read_query(spark: SparkSession, sql: str, params: Mapping | None = None, **views: DataFrame) -> DataFrame:
    """Parameterised SQL over named DataFrames; parameters are bound, never spliced."""
    return spark.sql(sql, args=dict(params or {}), **views)


def read_sources(readers: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """Union of several sources, each row labelled; a source that cannot be planned is reported.

    The plans are only unioned: Spark reads the sources in parallel.
    """
    out, errors = None, {}
    for name, reader in readers.items():
        try:
            df = reader().withColumn("source", F.lit(name))
        except Exception as exc:  # noqa: BLE001 - one bad source must not stop the others
            errors[name] = str(exc).splitlines()[0]
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, errors


def map_fields(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Source fields to canonical names; a missing source field becomes NULL."""
    return df.select(*[
        (F.col(src) if src in df.columns else F.lit(None).cast("string")).alias(dst) for src, dst in mapping.items()])


def batches(df: DataFrame, batch_size: int = 50_000) -> Iterator[list]:
    """Rows in batches for an outside consumer; one partition at a time reaches the driver."""
    batch: list = []
    for row in df.toLocalIterator(prefetchPartitions=False):
        batch.append(row)
        if len(batch) >= batch_size:
            yield batch
            batch = []
    if batch:
        yield batch
