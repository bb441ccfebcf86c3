"""Recomputed demand per customer and its reconciliation with the previous values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions import electric as E
from wattledger.functions.classify import catalogue_key
from wattledger.params import TARIFF_CLASSES, Demand

CAUSES = ["energy_as_demand", "period_days", "coincidence", "sqrt3", "cos_phi", "multiplier"]


def class_coefficients(key: Column) -> Column:
    """Struct of coefficients for a catalogue key; the first class when unknown."""
    names = list(next(iter(TARIFF_CLASSES.values())))
    def entry(values: dict[str, float]) -> Column:
        return F.struct(*[F.lit(float(values[n])).alias(n) for n in names])
    out = None
    for k, values in TARIFF_CLASSES.items():
        out = F.when(key == k, entry(values)) if out is None else out.when(key == k, entry(values))
    return out.otherwise(entry(next(iter(TARIFF_CLASSES.values()))))


def recompute_power(
    df: DataFrame, p: Demand = Demand(), *, energy: str = "avg_kwh", tariff: str = "tariff", phases: str = "phases"
) -> DataFrame:
    """P average and peak, Q, S and current per customer. A narrow projection."""
    e = F.coalesce(F.nanvl(F.col(energy), F.lit(0.0)), F.lit(0.0))
    with_class = df.select(
        "*", e.alias("energy_used"), class_coefficients(catalogue_key(F.col(tariff), list(TARIFF_CLASSES))).alias("__c")
    )
    c = F.col("__c")
    avg = E.average_power_kw(F.col("energy_used"), p.days)
    if p.method == "velander":
        peak = E.velander_kw(F.col("energy_used"), c["a"], c["b"])
    else:
        peak = E.peak_by_load_factor(avg, c["load_factor"])
    n = F.coalesce(F.col(phases), F.lit(1)).cast("int")
    return (
        with_class.withColumns({"p_avg_kw": avg, "p_max_kw": peak, "cos_phi": c["cos_phi"], "phase_count": n})
        .withColumn("q_kvar", E.reactive_kvar(F.col("p_max_kw"), F.col("cos_phi")))
        .withColumn("s_kva", E.apparent_kva(F.col("p_max_kw"), F.col("q_kvar")))
        .withColumn("current_a", E.current_a(F.col("s_kva"), F.col("phase_count"), p.v_ln, p.v_ll))
        .drop("__c")
    )


def reconcile(previous: DataFrame, recomputed: DataFrame, p: Demand = Demand()) -> DataFrame:
    """Deltas against the previous P/Q with their causes, one row per common account."""
    prev = previous.select(
        "account",
        F.coalesce("p_prev_kw", F.lit(0.0)).alias("p_prev_kw"),
        F.coalesce("q_prev_kvar", F.lit(0.0)).alias("q_prev_kvar"),
        F.coalesce(F.col("division").cast("string"), F.lit("SIN_DIVISION")).alias("division"),
        F.coalesce("tariff", F.lit("SIN_CLASE")).alias("tariff_class"),
    )
    new = recomputed.select("account", "energy_used", "p_max_kw", "q_kvar", "s_kva", "phase_count")
    delta = F.col("p_max_kw") - F.col("p_prev_kw")
    three_phase = F.col("s_kva") * 1000.0 / F.lit(math.sqrt(3.0) * p.v_ll)
    actual = E.current_a(F.col("s_kva"), F.col("phase_count"), p.v_ln, p.v_ll)
    zero = F.lit(0.0)
    return prev.join(new, "account").select(
        "account", "division", "tariff_class", "p_prev_kw",
        F.col("p_max_kw").alias("p_new_kw"),
        delta.alias("delta_p_kw"),
        (delta * 100.0 / F.nullif(F.abs("p_prev_kw"), F.lit(0.0))).alias("delta_p_pct"),
        "q_prev_kvar",
        F.col("q_kvar").alias("q_new_kvar"),
        (F.col("q_kvar") - F.col("q_prev_kvar")).alias("delta_q_kvar"),
        (F.col("energy_used") / F.lit(p.days * 24.0) - F.col("energy_used")).alias("cause_energy_as_demand"),
        zero.alias("cause_period_days"),
        zero.alias("cause_coincidence"),
        ((actual - three_phase) * F.lit(p.v_ln) / 1000.0).alias("cause_sqrt3"),
        zero.alias("cause_cos_phi"),
        zero.alias("cause_multiplier"),
    )


def reconciliation_by_class(reconciled: DataFrame) -> DataFrame:
    g = reconciled.groupBy("division", "tariff_class").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("p_prev_kw").alias("p_prev_sum"),
        F.sum("p_new_kw").alias("p_new_sum"),
        F.sum("delta_p_kw").alias("delta_p_sum"),
    )
    return g.withColumn(
        "delta_p_pct", F.col("delta_p_sum") / F.nullif(F.abs("p_prev_sum"), F.lit(0.0)) * 100.0
    )


def reconciliation_causes(reconciled: DataFrame) -> DataFrame:
    """Total kW by cause, and overall totals, in one row."""
    return reconciled.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("p_prev_kw").alias("p_prev_total"),
        F.sum("p_new_kw").alias("p_new_total"),
        F.sum("delta_p_kw").alias("delta_p_total"),
        *[F.sum(f"cause_{c}").alias(f"cause_{c}") for c in CAUSES],
    )
