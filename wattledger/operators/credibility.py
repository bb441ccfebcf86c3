"""Unlinked customers and the coherence verdict of each feeder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clean(gis: DataFrame) -> DataFrame:
    key = F.col("account").cast("string")
    return gis.withColumn("account", key).where(key.isNotNull() & ~key.isin("", "nan", "None"))


def unmatched(commercial: DataFrame, gis: DataFrame) -> DataFrame:
    """Accounts billed but not on the network, and on the network but not billed.

    Two anti-joins on the account as text; blank network keys are dropped.
    """
    bill = commercial.select(F.col("account").cast("string").alias("account"), "kwh", "route")
    net = _clean(gis).select("account").distinct()
    no_gis = bill.join(net, "account", "left_anti").select(
        "account", F.coalesce("kwh", F.lit(0.0)).alias("kwh"), "route", F.lit("CSV_SIN_SIG").alias("direction"))
    no_bill = net.join(bill.select("account").distinct(), "account", "left_anti").select(
        "account", F.lit(None).cast("double").alias("kwh"), F.lit(None).cast("string").alias("route"),
        F.lit("SIG_SIN_CSV").alias("direction"))
    return no_gis.unionByName(no_bill)


def linkage(commercial: DataFrame, gis: DataFrame, threshold_pct: float = 95.0) -> DataFrame:
    """One row: accounts and energy linked to the network, and fitness for a measured balance."""
    net = _clean(gis).select("account").distinct().withColumn("__on", F.lit(True))
    bill = commercial.groupBy(F.col("account").cast("string").alias("account")).agg(
        F.sum(F.coalesce("kwh", F.lit(0.0))).alias("kwh"))
    joined = bill.join(net, "account", "full_outer")
    billed, on = F.col("kwh").isNotNull(), F.col("__on").isNotNull()
    both = F.count_if(billed & on)
    energy = F.coalesce(F.sum("kwh"), F.lit(0.0))
    linked = F.coalesce(F.sum(F.when(on, F.col("kwh"))), F.lit(0.0))
    out = joined.agg(
        F.count_if(billed).alias("n_billed"), F.count_if(on).alias("n_network"), both.alias("n_linked"),
        energy.alias("energy_kwh"), linked.alias("linked_kwh"),
    )
    pct = lambda a, b: F.coalesce(F.col(a) * 100.0 / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return out.select(
        "n_billed", "n_network", "n_linked",
        (F.col("n_billed") - F.col("n_linked")).alias("billed_not_network"),
        (F.col("n_network") - F.col("n_linked")).alias("network_not_billed"),
        pct("n_linked", "n_billed").alias("pct_accounts"),
        pct("linked_kwh", "energy_kwh").alias("pct_energy"),
        (F.col("energy_kwh") - F.col("linked_kwh")).alias("unlinked_kwh"),
        (pct("linked_kwh", "energy_kwh") >= threshold_pct).alias("fit_for_measured"),
    )


def unmatched_by_route(unmatched_rows: DataFrame) -> DataFrame:
    return unmatched_rows.where(F.col("direction") == "CSV_SIN_SIG").groupBy("route").agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("kwh").alias("unlinked_kwh"))


# Severity, publishable and excluded by control code.
RULES = {
    "C01": ("BLOQUEANTE", False, True), "C02": ("ALTA", True, True), "C03": ("BLOQUEANTE", False, True),
    "C04": ("ALTA", True, False), "C05": ("MEDIA", True, False), "C06": ("ALTA", True, True),
    "TRANSFER": ("ALTA", True, True), "VINCULACION": ("ALTA", True, True), "CONFIABILIDAD": ("ALTA", True, True),
}
_ORDER = {"MEDIA": 1, "ALTA": 2, "BLOQUEANTE": 3}


def _rule(code: Column, at: int, default) -> Column:
    out = F.lit(default)
    for k, v in RULES.items():
        out = F.when(code == k, F.lit(v[at])).otherwise(out)
    return out


def incoherences(
    balances: DataFrame, *, transferred: DataFrame | None = None, link: DataFrame | None = None,
    confidence: DataFrame | None = None, min_confidence: float = 50.0,
) -> DataFrame:
    """One row per feeder and triggered rule, with severity and consequences.

    ``transferred`` (feeder), ``link`` (one row of :func:`linkage`) and
    ``confidence`` (feeder, confidence) add their own rules.
    """
    base = balances.select("feeder", F.explode("controls").alias("c")).where("c.triggered").select(
        "feeder", F.col("c.code").alias("code"), F.col("c.observed").alias("observed"), F.col("c.threshold").alias("threshold"))
    feeders = balances.select("feeder")
    none = F.lit(None).cast("double")
    if transferred is not None:
        hit = feeders.join(transferred.select("feeder").distinct(), "feeder", "left_semi")
        base = base.unionByName(hit.select("feeder", F.lit("TRANSFER").alias("code"), none.alias("observed"), none.alias("threshold")))
    if link is not None:
        bad = link.where(~F.col("fit_for_measured")).select("pct_energy")      # at most one row
        base = base.unionByName(feeders.crossJoin(F.broadcast(bad)).select(
            "feeder", F.lit("VINCULACION").alias("code"), F.col("pct_energy").alias("observed"), F.lit(95.0).alias("threshold")))
    if confidence is not None:
        low = feeders.join(confidence.where(F.col("confidence") < min_confidence), "feeder")
        base = base.unionByName(low.select(
            "feeder", F.lit("CONFIABILIDAD").alias("code"), F.col("confidence").alias("observed"),
            F.lit(min_confidence).alias("threshold")))
    code = F.col("code")
    return base.select(
        "*", _rule(code, 0, "MEDIA").alias("severity"), _rule(code, 1, True).alias("publishable"),
        _rule(code, 2, False).alias("excluded"))


def feeder_verdict(balances: DataFrame, found: DataFrame) -> DataFrame:
    """Worst severity, number of findings and consequences per feeder; OK when none."""
    order = F.lit(0)
    for k, v in _ORDER.items():
        order = F.when(F.col("severity") == k, F.lit(v)).otherwise(order)
    g = found.groupBy("feeder").agg(
        F.max_by("severity", order).alias("__s"), F.count(F.lit(1)).alias("__n"),
        F.bool_and("publishable").alias("__p"), F.bool_or("excluded").alias("__x"))
    return balances.select("feeder").distinct().join(g, "feeder", "left").select(
        "feeder", F.coalesce("__s", F.lit("OK")).alias("max_severity"), F.coalesce("__n", F.lit(0)).alias("findings"),
        F.coalesce("__p", F.lit(True)).alias("publishable"), F.coalesce("__x", F.lit(False)).alias("excluded"))


def coherence_summary(verdict: DataFrame) -> DataFrame:
    return verdict.agg(
        F.count(F.lit(1)).alias("feeders"),
        F.count_if(F.col("findings") > 0).alias("incoherent"),
        F.count_if(F.col("max_severity") == "BLOQUEANTE").alias("blocking"),
        F.count_if("excluded").alias("excluded"),
    )
