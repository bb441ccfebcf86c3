"""Scenario evaluation as incremental recomputation of the touched feeders.

A scenario copies only the feeders that its applicable changes touch, under the key ``scenario/feeder``, and the grid
analysis runs over these copies. Each copy has a digest of everything the analysis reads of it; where results of an
earlier evaluation with the same digest are at hand they are taken over, and only the other copies are oriented, flowed
and balanced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.operators import network
from wattledger.plans.grid import analyse_grid
from wattledger.staging import stage

#: Tables with changeable fields: layer, key column, column by field.
FIELDS = {"customers": ("cliente", "account", {"kwh": "energy_kwh"}), "sites": ("puesto", "site", {"kva": "kva"})}
RESULT = ["scenario", "feeder", "digest", "input_kwh", "billed_kwh", "technical_kwh", "ntl_kwh", "ntl_pct", "balance_type", "v_min_pu", "converged", "reused"]


def scenario_tables(overlaid: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``tables`` restricted to the touched feeders, copied per scenario and with the changed fields put in.

    ``overlaid``: scenario, feeder, layer, element, field, value, changed (``operators.scenarios.overlay``). A value that is
    no number leaves the field as it was. The copies' ``feeder`` is ``scenario/feeder``.
    """
    changed = stage(overlaid.where("changed"), "changed")
    key = F.concat_ws("/", "scenario", "feeder")
    touched = changed.select("feeder", key.alias("__copy")).distinct()
    out = {}
    for name, df in tables.items():
        df = df.join(touched, "feeder").withColumn("feeder", F.col("__copy")).drop("__copy")
        if name in FIELDS:
            layer, element, columns = FIELDS[name]
            new = changed.where(F.col("layer") == layer).groupBy(key.alias("feeder"), F.col("element").alias("__element")).agg(*[
                F.max(F.when(F.col("field") == f, F.expr("try_cast(value AS double)"))).alias(f"__{c}") for f, c in columns.items()])
            df = df.withColumn("__element", F.col(element).cast("string")).join(new, ["feeder", "__element"], "left").withColumns(
                {c: F.coalesce(f"__{c}", c) for c in columns.values()}).drop("__element", *[f"__{c}" for c in columns.values()])
        out[name] = df
    return out


def digests(tables: dict[str, DataFrame]) -> DataFrame:
    """``feeder, digest`` of all rows of all tables, whatever their order."""
    rows = None
    for name, df in sorted(tables.items()):
        part = df.select("feeder", F.concat_ws("|", F.lit(name), F.to_json(F.struct(*sorted(c for c in df.columns if c != "feeder")))).alias("__row"))
        rows = part if rows is None else rows.unionByName(part)
    return network.digest_rows(rows, [F.col("__row")], "digest")


def evaluate_scenarios(
    overlaid: DataFrame, tables: dict[str, DataFrame], conductors: DataFrame, catalogue: Sequence[dict], known: DataFrame | None = None, **options,
) -> DataFrame:
    """``RESULT`` per scenario and touched feeder.

    ``tables``: edges, sources, sites, customers, lamps, head, as ``analyse_grid`` takes them. ``known``: results of an
    earlier evaluation; a copy with the same digest is taken from it (``reused``). Conductors and catalogue are taken to
    be the same.
    """
    copies = {name: stage(df, f"copy_{name}") for name, df in scenario_tables(overlaid, tables).items()}
    prints = stage(digests(copies), "digests")
    split = [F.substring_index("__copy", "/", 1).alias("scenario"), F.expr("substr(__copy, instr(__copy, '/') + 1)").alias("feeder")]
    old = None
    if known is not None:
        named = prints.withColumnRenamed("feeder", "__copy").select("__copy", *split, "digest")
        old = stage(named.join(known.drop("reused"), ["scenario", "feeder", "digest"]), "reused")
        fresh = prints.join(old.select(F.col("__copy").alias("feeder")), "feeder", "left_anti").select("feeder")
        copies = {name: df.join(fresh, "feeder", "left_semi") for name, df in copies.items()}
    plan = analyse_grid(
        stage(copies["edges"], "edges"), copies["sources"], conductors, copies["sites"], stage(copies["customers"], "customers"),
        copies["lamps"], catalogue, copies["head"], **options)
    new = plan.balance.join(prints, "feeder").withColumnRenamed("feeder", "__copy").withColumn("reused", F.lit(False)).select(
        *split, *[c for c in RESULT if c not in ("scenario", "feeder")])
    return new if old is None else new.unionByName(old.withColumn("reused", F.lit(True)).select(*RESULT))
