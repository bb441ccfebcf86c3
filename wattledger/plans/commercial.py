"""Commercial analysis end to end: readings and register to a ranked list of customers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.functions.classify import classify_distinct, segment_columns
from wattledger.operators import demand, peers, scoring, series, signals
from wattledger.params import Averaging, Demand, Segmentation, Signals
from wattledger.staging import stage


def analyse(
    register: DataFrame, readings: DataFrame, *, last_month: date, months: int = 36, averaging: Averaging = Averaging(),
    load: Demand = Demand(), segmentation: Segmentation = Segmentation(), thresholds: Signals = Signals(), unsupervised: bool = True,
) -> dict[str, DataFrame]:
    """Customers with power and segment, signal matrix, ranking and reconciliation.

    ``register``: account, tariff, phases, route, site, active, p_prev_kw, q_prev_kvar,
    division. ``readings``: account, period, kwh. The customer table is staged once
    and everything after it reads that stage.
    """
    rows = series.with_all_accounts(register, series.account_series(readings, last_month, months), months)
    rows = segment_columns(classify_distinct(series.series_statistics(rows, segmentation)), segmentation)
    rows = series.representative_average(
        rows.withColumn("suspended", ~F.coalesce("active", F.lit(True))), averaging,
        first_month=series.month_axis(last_month, months)[0].month)
    customers = stage(demand.recompute_power(rows, load), "customers")
    peered = peers.assign_peer_group(customers, segmentation.min_peers)
    matrix = stage(signals.signal_matrix(peered, thresholds), "signals")
    ranking = scoring.score_customers(matrix, thresholds, unsupervised=unsupervised)
    return {
        "customers": customers,
        "signals": matrix.select("account", *signals.ALL_SIGNALS),
        "evidence": signals.evidence(matrix),
        "ranking": ranking,
        "reconciliation": demand.reconcile(customers, customers, load),
        "segments": peers.segment_summary(customers, "segment"),
    }
