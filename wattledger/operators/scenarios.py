"""What-if overlays on element tables and the comparison of their iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.operators.balance import worst_type

EVALUABLE = ("MODIFICAR", "RECONECTAR")


def not_applied(changes: DataFrame, elements: DataFrame, layers: list[str]) -> DataFrame:
    """Changes that cannot be evaluated, with the reason; none is dropped silently.

    ``elements``: layer, element.
    """
    known = elements.select("layer", "element").distinct().withColumn("__k", F.lit(True))
    j = changes.join(known, ["layer", "element"], "left")
    reason = (
        F.when(~F.coalesce(F.col("operation").isin(*EVALUABLE), F.lit(False)), "OPERACION_NO_EVALUABLE")
        .when(~F.coalesce(F.col("layer").isin(*layers), F.lit(False)), "CAPA_DESCONOCIDA")
        .when(F.col("__k").isNull(), "ELEMENTO_AUSENTE")
        .when(F.coalesce(F.trim("field") == "", F.lit(True)), "SIN_CAMPO"))
    return j.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("__k")


def overlay(values: DataFrame, changes: DataFrame, layers: list[str]) -> DataFrame:
    """Long attribute values with the scenario's last change per element and field applied.

    ``values``: feeder, layer, element, field, value. A scenario covers the feeders its
    applicable changes touch, found by equi-joins; the other feeders are not copied.
    A change may add a field the element did not have. The input is not modified.
    """
    bad = not_applied(changes, values, layers).select("scenario", "seq")
    good = changes.join(bad, ["scenario", "seq"], "left_anti")
    last = good.groupBy("scenario", "layer", "element", "field").agg(F.max_by(F.struct("after"), "seq").alias("c"))
    home = values.select("layer", "element", "feeder").distinct()
    placed = last.join(home, ["layer", "element"])
    whole = placed.select("scenario", "feeder").distinct().join(values, "feeder")
    return whole.join(placed, ["scenario", "feeder", "layer", "element", "field"], "full_outer").select(
        "scenario", "feeder", "layer", "element", "field",
        F.when(F.col("c").isNotNull(), F.col("c.after")).otherwise(F.col("value")).alias("value"),
        F.col("c").isNotNull().alias("changed"))


def scenario_totals(balance: DataFrame) -> DataFrame:
    """Totals per scenario: energies summed, percentages recomputed, worst type."""
    g = balance.groupBy("scenario").agg(
        *[F.sum(c).alias(c) for c in ("input_kwh", "billed_kwh", "technical_kwh", "ntl_kwh")],
        F.count_distinct("feeder").alias("feeders"), worst_type("balance_type").alias("balance_type"))
    pct = lambda c: F.col(c) / F.when(F.col("input_kwh") > 0, F.col("input_kwh")) * 100
    return g.withColumns({"ntl_pct": pct("ntl_kwh"), "technical_pct": pct("technical_kwh")})


def next_iteration(history: DataFrame, totals: DataFrame) -> DataFrame:
    """Append one immutable iteration per scenario, numbered after its last."""
    last = history.groupBy("scenario").agg(F.max("iteration").alias("__n"))
    fresh = totals.join(last, "scenario", "left").withColumn("iteration", F.coalesce("__n", F.lit(0)) + 1).drop("__n")
    return history.unionByName(fresh, allowMissingColumns=True)


def evolution(iterations: DataFrame, scenario: str) -> DataFrame:
    return iterations.where(F.col("scenario") == scenario).orderBy("iteration")


def compare_iterations(iterations: DataFrame, a: int, b: int, metrics: list[str]) -> DataFrame:
    """Difference and % of each metric between two iterations, with the two warnings."""
    def side(n: int, tag: str) -> DataFrame:
        rows = iterations.where(F.col("iteration") == n)
        return rows.select("scenario", F.col("topology").alias(f"t_{tag}"), F.col("balance_type").alias(f"b_{tag}"), F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(f"v_{tag}")) for m in metrics])))
    j = side(a, "a").join(side(b, "b"), ["scenario", "metric"])
    diff = F.col("v_b") - F.col("v_a")
    return j.where(F.col("v_a").isNotNull() & F.col("v_b").isNotNull()).select(
        "scenario", "metric", F.round("v_a", 3).alias("before"), F.round("v_b", 3).alias("after"), F.round(diff, 3).alias("difference"),
        F.round(100.0 * diff / F.nullif(F.abs("v_a"), F.lit(0.0)), 2).alias("pct"),
        F.coalesce(F.col("t_a") != F.col("t_b"), F.lit(False)).alias("topology_changed"),
        F.coalesce(F.col("b_a") != F.col("b_b"), F.lit(False)).alias("type_changed"))
