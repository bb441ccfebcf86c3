"""Defining, distributing and following field work; row scope by organisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattledger.operators.ranking import attach, global_rank
from wattledger.staging import stage


def select_feeders(customers: DataFrame, feeders: Sequence[str]) -> DataFrame:
    return customers.where(F.col("feeder").isin(*feeders))


def select_accounts(customers: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Customers in a list, and the listed accounts that were not found."""
    return (customers.join(wanted.select("account").distinct(), "account", "left_semi"),
            wanted.select("account").distinct().join(customers.select("account"), "account", "left_anti"))


def compact_blocks(customers: DataFrame, size: int) -> DataFrame:
    """Add ``block``: about ``size`` neighbours each, along a serpentine over a grid.

    The cell side makes one block per cell on average; positions come from the
    distributed rank, so the whole work area is never in one task.
    """
    c = stage(customers, "work")
    box = c.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    side = F.greatest(F.sqrt(F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)) * F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
                             / F.greatest(F.lit(1), F.ceil(F.col("n") / size))), F.lit(1.0))
    b = box.select("x0", "y0", side.alias("side"))                                   # one row
    g = c.crossJoin(F.broadcast(b)).withColumns({
        "__cx": F.floor((F.col("x") - F.col("x0")) / F.col("side")), "__cy": F.floor((F.col("y") - F.col("y0")) / F.col("side"))})
    turn = F.when(F.col("__cy") % 2 == 0, F.col("__cx")).otherwise(-F.col("__cx"))
    ranked = global_rank(g.withColumn("__t", turn), [F.col("__cy"), F.col("__t"), F.col("account")], out="__pos")
    return ranked.withColumn("block", F.ceil(F.col("__pos") / size).cast("int")).drop("__cx", "__cy", "__t", "__pos", "x0", "y0", "side")


# Campaigns that chase energy; the others carry no energy figure.
ENERGY_CAMPAIGNS = ("INSPECCION_PNT", "VERIFICACION_MEDICION", "GRANDES_CLIENTES")


def orders_from_blocks(blocks: DataFrame, campaign: str) -> DataFrame:
    """One order per block; energy only for energy campaigns."""
    energy = F.sum(F.coalesce("recoverable_kwh", F.lit(0.0))) if campaign in ENERGY_CAMPAIGNS else F.lit(0.0)
    g = blocks.groupBy("block").agg(
        F.count(F.lit(1)).alias("customers"), F.round(energy, 1).alias("kwh"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return g.withColumn("work_order", F.format_string("OT-%05d", "block")).withColumn("campaign", F.lit(campaign))


def plan_to_orders(orders: DataFrame, campaign: str) -> DataFrame:
    out = orders.withColumn("campaign", F.lit(campaign))
    return out if campaign in ENERGY_CAMPAIGNS else out.withColumn("kwh", F.lit(0.0))


def merge_campaigns(*campaigns: DataFrame) -> DataFrame:
    """Union of campaigns with ids renumbered in order of campaign and old id."""
    out = None
    for i, c in enumerate(campaigns):
        t = c.withColumn("__c", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return global_rank(out, [F.col("__c"), F.col("work_order")], out="__n").withColumn(
        "work_order", F.format_string("OT-%06d", "__n")).drop("__c", "__n")


def distribute(orders: DataFrame, crews: DataFrame, cap: int | None = None) -> DataFrame:
    """Assign orders to crews of the same unit, balanced by weight and compact by direction.

    Orders are ranked by weight inside a unit and taken in tiers of one order per
    crew; within a tier the crews follow the direction from the unit's centre. Each
    crew so gets one order of every tier, and orders of one direction. As the tiers
    descend by weight, the loads of two crews differ by the heaviest order at most.

    No order is lost: ``leftover`` says why an order has no crew, SIN_CUADRILLA where
    its unit has none (or it has no unit), CUPO beyond ``cap`` tiers, else NULL.
    """
    # Crews of one unit: bounded by the staff, not by the orders.
    numbered = crews.select("unit", "crew").distinct().withColumn(
        "slot", F.row_number().over(Window.partitionBy("unit").orderBy("crew")) - 1)
    n = numbered.groupBy("unit").agg(F.count("crew").alias("crews"))
    centre = orders.groupBy("unit").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    ranked = global_rank(orders, [F.col("weight").desc(), F.col("work_order")], partition=["unit"], out="__pos")
    tiered = stage(attach(attach(ranked, n, ["unit"]), centre, ["unit"]).withColumns({
        "tier": F.floor((F.col("__pos") - 1) / F.nullif("crews", F.lit(0))),
        "__angle": F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))}).drop("__pos", "cx", "cy"), "tiers")
    reason = F.when(F.coalesce("crews", F.lit(0)) == 0, "SIN_CUADRILLA").when(F.col("tier") >= F.lit(cap), "CUPO")
    marked = tiered.withColumn("leftover", reason).drop("crews")
    # A tier has one order per crew: the window is bounded by the crews of a unit. Leftovers never enter it.
    slot = F.row_number().over(Window.partitionBy("unit", "tier").orderBy("__angle", "work_order")) - 1
    placed = marked.where("leftover is null").withColumn("slot", slot).join(numbered, ["unit", "slot"]).drop("slot")
    return placed.unionByName(marked.where("leftover is not null").withColumn("crew", F.lit(None).cast(placed.schema["crew"].dataType))).drop("__angle")


def assignment_metrics(assigned: DataFrame) -> DataFrame:
    """Per crew: orders, weight and mean distance to its centroid."""
    a = assigned.where(F.col("crew").isNotNull())
    c = a.groupBy("unit", "crew").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("weight").alias("weight"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    spread = a.select("unit", "crew", "x", "y").join(c.select("unit", "crew", "cx", "cy"), ["unit", "crew"]).groupBy("unit", "crew").agg(
        (F.avg(d) / 1000.0).alias("spread_km"))
    return c.drop("cx", "cy").join(spread, ["unit", "crew"])


def imbalance(metrics: DataFrame) -> DataFrame:
    """Gap between the most and least loaded crew of a unit, over the mean."""
    return metrics.groupBy("unit").agg(
        F.count(F.lit(1)).alias("crews"),
        F.coalesce((F.max("weight") - F.min("weight")) / F.nullif(F.avg("weight"), F.lit(0.0)) * 100, F.lit(0.0)).alias("imbalance_pct"))


STATES = ["ASIGNADA", "DESCARGADA", "EN_PROCESO", "COMPLETADA", "SINCRONIZADA", "RECHAZADA"]
# Legal next states of an order.
TRANSITIONS = {
    "ASIGNADA": ("DESCARGADA", "RECHAZADA"), "DESCARGADA": ("EN_PROCESO", "RECHAZADA"), "EN_PROCESO": ("COMPLETADA", "RECHAZADA"),
    "COMPLETADA": ("SINCRONIZADA", "RECHAZADA"), "SINCRONIZADA": (), "RECHAZADA": ("ASIGNADA",),
}


def crew_workload(crews: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders, customers and energy per crew and state; crews without orders stay."""
    g = orders.groupBy("crew").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("customers").alias("customers"), F.sum("kwh").alias("kwh"),
        *[F.count_if(F.col("state") == s).alias(s.lower()) for s in STATES])
    return crews.select("crew").distinct().join(g, "crew", "left").fillna(0)


def stalled_orders(orders: DataFrame, as_of: Column, days: int = 5) -> DataFrame:
    """Open orders without progress for ``days``: last progress, else the assignment date."""
    last = F.coalesce(F.nullif("last_progress", F.lit("")).try_cast("timestamp"), F.col("assigned_at"))
    return orders.where(F.col("state").isin("ASIGNADA", "DESCARGADA", "EN_PROCESO") & (last < as_of - F.expr(f"interval {int(days)} days")))


def illegal_transitions(log: DataFrame) -> DataFrame:
    """State changes that the order's life does not allow.

    ``log``: work_order, at, state, id. Positions come from the distributed rank and
    neighbours are joined, so an order with a huge log is not one task's window.
    """
    r = stage(global_rank(log, [F.col("at"), F.col("id")], partition=["work_order"], out="pos"), "states")
    before = r.select("work_order", (F.col("pos") + 1).alias("pos"), F.col("state").alias("previous"))
    allowed = F.lit(False)
    for a, nexts in TRANSITIONS.items():
        if nexts:
            allowed = allowed | ((F.col("previous") == a) & F.col("state").isin(*nexts))
    return r.join(before, ["work_order", "pos"]).where(~allowed).select("work_order", "id", "previous", "state")


def scope(df: DataFrame, units: Sequence[str] | None, *, everything: bool = False, hierarchy: DataFrame | None = None) -> DataFrame:
    """Rows of the user's units. Fail-closed: no unit known or none assigned gives no rows.

    The unit is derived from the feeder column when the table lacks it.
    """
    if everything:
        return df
    if not units:
        return df.limit(0)
    if "unit" not in df.columns:
        if hierarchy is None or "feeder" not in df.columns:
            return df.limit(0)
        inside = hierarchy.where(F.col("unit").isin(*units)).select("feeder").distinct()
        return df.join(inside, "feeder", "left_semi")
    return df.where(F.col("unit").isin(*units))


def resolve_entities(hierarchy: DataFrame) -> DataFrame:
    """Unit and number of feeders of each feeder, substation and unit; a split substation has no unit."""
    f = hierarchy.select(F.lit("ALIMENTADOR").alias("level"), F.col("feeder").alias("entity"), "unit", F.lit(1).cast("bigint").alias("feeders"))
    s = hierarchy.groupBy(F.col("substation").alias("entity")).agg(
        F.count_distinct("unit").alias("__u"), F.min("unit").alias("unit"), F.count_distinct("feeder").alias("feeders")).select(
        F.lit("SUBESTACION").alias("level"), "entity", F.when(F.col("__u") == 1, F.col("unit")).otherwise(F.lit("")).alias("unit"), "feeders")
    u = hierarchy.groupBy(F.col("unit").alias("entity")).agg(F.count_distinct("feeder").alias("feeders")).select(
        F.lit("UNIDAD_NEGOCIO").alias("level"), "entity", F.col("entity").alias("unit"), "feeders")
    return f.unionByName(s).unionByName(u)
