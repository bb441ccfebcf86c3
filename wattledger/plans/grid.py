"""Grid analysis end to end: a network with its customers and lamps to losses, balance, controls and signals per feeder.

All feeders go through every step at once. What several outputs read (tree, placement, flow, zones) is staged once. A
feeder may be any key, so a scenario's copies of feeders are analysed as feeders of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.functions import electric
from wattledger.operators import balance, losses, network, powerflow, signals
from wattledger.operators.rangejoin import catalogue_nearest
from wattledger.params import TARIFF_CLASSES, Balance, Losses
from wattledger.staging import stage


@dataclass(frozen=True)
class GridPlan:
    """``tree``; ``flow`` (one row a feeder); ``zones`` and ``transformers`` by site; ``components`` and ``balance`` by feeder."""

    tree: DataFrame
    flow: DataFrame
    zones: DataFrame
    transformers: DataFrame
    components: DataFrame
    balance: DataFrame

    def component_rows(self) -> DataFrame:
        """``feeder, component, kwh``; the neutral only where it loses energy, as a part of the conductors."""
        names = {"RED_CONDUCTORES": "conductors_kwh", "TRANSF_DIST_TOTAL": "transformers_kwh", "TRANSF_DIST_VACIO": "noload_kwh",
                 "MEDIDORES": "meters_kwh", "NEUTRO": "neutral_kwh"}
        rows = self.components.select("feeder", F.inline(F.array(*[
            F.struct(F.lit(k).alias("component"), F.col(c).alias("kwh")) for k, c in names.items()])))
        return rows.where((F.col("component") != "NEUTRO") | (F.col("kwh") > 0))

    def totaliser_signals(self) -> DataFrame:
        """N3 per site with a totaliser."""
        residual, value = signals.totaliser_balance(F.col("totaliser_kwh"), F.col("individuals_kwh"))
        return self.zones.where("totaliser_kwh > 0").select("feeder", "site", residual.alias("residual_kwh"), value.alias("n3"))

    def bands(self, draws: int = 200) -> tuple[DataFrame, DataFrame]:
        """P10/P50/P90 of the technical and of the non-technical loss."""
        technical = stage(losses.montecarlo_losses(self.components, draws=draws), "bands")
        return technical, losses.montecarlo_ntl(self.balance, technical, draws=draws)


def analyse_grid(
    edges: DataFrame, sources: DataFrame, conductors: DataFrame, sites: DataFrame, customers: DataFrame, lamps: DataFrame,
    catalogue: Sequence[dict], head: DataFrame | None = None, *, hours: float = 720.0, p: Losses = Losses(), limits: Balance = Balance(),
) -> GridPlan:
    """Three-phase flow with neutral, losses by component, low-voltage zones, and the balance with its controls.

    ``customers``: feeder, node, account, energy_kwh, phase, totaliser, under_totaliser, meter_type. ``head``: feeder,
    input_kwh; a feeder without it is balanced from its billed energy (INDICATIVO). Customers below no site are billed,
    unless a totaliser bills them. Feeders without sites, meters or loads keep their rows.
    """
    c0 = next(iter(TARIFF_CLASSES.values()))
    factor = p.k_default * c0["load_factor"] + (1 - p.k_default) * c0["load_factor"] ** 2
    tree = network.orient(edges, sources)
    place = stage(network.assign_to_sites(tree, None, sites), "placement")
    z = stage(powerflow.impedances(tree, edges, conductors, t_op=p.t_operation, alpha=p.alpha_al, t_ref=p.t_reference), "z")
    kw = electric.velander_kw(F.col("energy_kwh"), F.lit(c0["a"]), F.lit(c0["b"]))
    flow = stage(powerflow.unbalanced_summary(powerflow.unbalanced_flow(
        z, powerflow.loads_by_phase(customers, kw), stage(powerflow.base_voltages(z, edges, sources), "base"), pf=c0["cos_phi"])), "flow")

    zones = stage(network.lv_zones(sites, customers, lamps, place), "zones")
    kinds = sites.select("feeder", "site", "kvas", "config", "phases", "voltage_class")
    transformers = stage(losses.transformer_table(catalogue_nearest(zones.join(kinds, ["feeder", "site"]), catalogue), hours, factor, p), "transformers")
    by_site = transformers.groupBy("feeder").agg(F.sum("loss_kwh").alias("transformers_kwh"), F.sum("noload_kwh").alias("noload_kwh"))
    in_zones = zones.groupBy("feeder").agg(F.sum("billed_kwh").alias("__zones"), F.sum("lighting_kwh").alias("lighting_kwh"))
    placed = place.where(F.col("site").isNotNull()).select(*network.KEY)
    outside = customers.join(placed, network.KEY, "left_anti").where(~F.coalesce("under_totaliser", F.lit(False))).groupBy("feeder").agg(
        F.sum("energy_kwh").alias("__outside"))
    meters = losses.meter_loss_kwh(customers, "feeder", hours, p).withColumnRenamed("meter_kwh", "meters_kwh")
    counts = customers.groupBy("feeder").agg(F.count(F.lit(1)).alias("customers_traced"))
    energy = lambda c: (F.col(c) * hours * factor)
    out = flow.select("feeder", energy("loss_kw_peak").alias("conductors_kwh"), energy("loss_neutral_kw").alias("neutral_kwh"), "v_min_pu", "converged", "imbalance_pct_max")
    for part in (by_site, in_zones, outside, meters, counts):
        out = out.join(part, "feeder", "full")
    components = out.fillna(0, subset=[
        "conductors_kwh", "neutral_kwh", "transformers_kwh", "noload_kwh", "meters_kwh", "lighting_kwh", "__zones", "__outside", "customers_traced"])
    components = stage(components.withColumns({
        "technical_kwh": F.col("conductors_kwh") + F.col("transformers_kwh") + F.col("meters_kwh"),
        "billed_kwh": F.col("__zones") + F.col("__outside"), "customers_declared": F.col("customers_traced"),
        "energy_coverage_pct": F.lit(100.0)}).drop("__zones", "__outside"), "components")
    if head is not None:
        fed = components.join(head.select("feeder", "input_kwh"), "feeder", "left")
    else:
        fed = components.withColumn("input_kwh", F.lit(None).cast("double"))
    return GridPlan(tree, flow, zones, transformers, components, stage(balance.with_controls(balance.feeder_balance(fed, limits), limits), "balance"))
