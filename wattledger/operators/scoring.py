"""Consensus of signal ranks, recoverable energy, reasons and the final ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.operators.outliers import outlier_scores
from wattledger.operators.peers import recoverable, with_expected
from wattledger.operators.ranking import attach, exact_percentiles, global_rank
from wattledger.params import REASONS, SIGNALS, Signals
from wattledger.staging import stage

_DEFICIT = ["S4", "S5", "S8", "S9"]


def signal_ranks(signals: DataFrame, names: Sequence[str] = SIGNALS) -> DataFrame:
    """``(account, signal, value, rank_pct)`` for active signals only.

    The rank percentile counts every customer, but customers with a zero only
    shift the others, so just the active rows are ordered:
    ``rank = zeros + position among the active``. All signals are ranked in one
    range-partitioned pass; equal values are ordered by account.
    """
    long = signals.select(
        "account", F.inline(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in names]))
    ).where(F.col("value") > 0)
    ranked = global_rank(long, [F.col("value"), F.col("account")], partition=["signal"], out="pos")
    active = long.groupBy("signal").agg(F.count(F.lit(1)).alias("__a"))            # one row per signal
    total = signals.agg(F.count(F.lit(1)).alias("__n"))                             # one row
    return (
        ranked.join(F.broadcast(active.crossJoin(F.broadcast(total))), "signal")
        .select(
            "account", "signal", "value",
            ((F.col("__n") - F.col("__a") + F.col("pos") - 1) / F.greatest(F.col("__n") - 1, F.lit(1))).alias("rank_pct"),
        )
    )


def consensus(signals: DataFrame, names: Sequence[str] = SIGNALS) -> DataFrame:
    """``(account, consensus, n_signals)``: mean rank over the active signals, 0 if none."""
    ranks = signal_ranks(signals, names).groupBy("account").agg(
        F.avg("rank_pct").alias("__c"), F.count(F.lit(1)).alias("__k")
    )
    return signals.select("account").join(ranks, "account", "left").select(
        "account", F.coalesce("__c", F.lit(0.0)).alias("consensus"), F.coalesce("__k", F.lit(0)).alias("n_signals")
    )


def recoverable_energy(df: DataFrame, *, segmented: bool = True) -> DataFrame:
    """Add ``recoverable_kwh``: against the peer group and the own base, or the global median.

    Only customers with a deficit signal (S4, S5, S8, S9) get a value.
    """
    deficit = F.lit(False)
    for s in _DEFICIT:
        if s in df.columns:
            deficit = deficit | (F.col(s) > 0)
    if segmented:
        rec = recoverable(F.col("avg_kwh"), F.col("expected_kwh"), F.col("base_kwh"))
        return (df if "expected_kwh" in df.columns else with_expected(df)).withColumn("recoverable_kwh", F.when(deficit, rec).otherwise(F.lit(0.0)))
    median = exact_percentiles(df.where(F.col("avg_kwh") > 0), [], "avg_kwh", {"__med": 0.5}).select("__med")
    with_median = df.crossJoin(F.broadcast(median))   # one row
    rec = F.greatest(F.coalesce("__med", F.lit(0.0)) - F.coalesce("avg_kwh", F.lit(0.0)), F.lit(0.0))
    return with_median.withColumn("recoverable_kwh", F.when(deficit, rec).otherwise(F.lit(0.0))).drop("__med")


def reasons(df: DataFrame, names: Sequence[str] = SIGNALS) -> DataFrame:
    """Add ``reasons``: the three strongest active signals as text, strongest first.

    On equal intensity the later signal comes first. ``UNSUP`` fills a free place
    when the unsupervised score exceeds 0.8.
    """
    records = F.array(*[
        F.struct(F.col(s).alias("v"), F.lit(i).alias("i"), F.lit(REASONS[s]).alias("t")) for i, s in enumerate(names)
    ])
    active = F.filter(F.sort_array(records, asc=False), lambda r: r["v"] > 0)
    top = F.slice(F.transform(active, lambda r: r["t"]), 1, 3)
    if "unsupervised" in df.columns:
        extra = F.when(F.col("unsupervised") > 0.8, F.array(F.lit(REASONS["UNSUP"]))).otherwise(
            F.array().cast("array<string>")
        )
        top = F.slice(F.concat(top, extra), 1, 3)
    return df.withColumn("reasons", top)


def score_customers(df: DataFrame, p: Signals = Signals(), *, unsupervised: bool = True,
                    segmented: bool = True, names: Sequence[str] = SIGNALS, columns: Sequence[str] | None = None) -> DataFrame:
    """Full ranking: score, rank, recoverable energy, reasons.

    ``df`` should be a staged table: it is read once per aggregate below. With ``columns`` only those and the rank are kept:
    they are staged first, as ranges are found by a pass of its own, and the arrays of the customers are not sorted along.
    """
    scored = df.join(consensus(df, names), "account")
    if unsupervised:
        scored = scored.join(outlier_scores(df, names), "account").withColumn(
            "score",
            F.when(F.col("unsupervised").isNull(), F.col("consensus")).otherwise(
                0.7 * F.col("consensus") + 0.3 * F.col("unsupervised")
            ),
        )
    else:
        scored = scored.withColumn("score", F.col("consensus"))
    # Nine decimals: customers with the same evidence tie, whatever the order of the sums.
    scored = scored.withColumn("score", F.round("score", 9))
    scored = reasons(recoverable_energy(scored, segmented=segmented), names)
    if columns is not None:
        scored = stage(scored.select(*dict.fromkeys(["account", "score", *columns])), "scored")
    return global_rank(scored, [F.col("score").desc(), F.col("account")])


def suspects(ranking: DataFrame, contamination: float = 0.05) -> DataFrame:
    """Number of customers at or above the (1 - contamination) percentile of the score."""
    cut = exact_percentiles(ranking, [], "score", {"threshold": 1 - contamination}).select("threshold")  # one row
    return ranking.crossJoin(F.broadcast(cut)).groupBy("threshold").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum((F.col("score") >= F.col("threshold")).cast("bigint")).alias("suspects"),
    )


def flag_suspects(ranking: DataFrame, contamination: float = 0.05) -> DataFrame:
    """Add ``is_suspect``: score at or above the (1 - contamination) percentile."""
    cut = exact_percentiles(ranking, [], "score", {"__cut": 1 - contamination}).select("__cut")
    return ranking.crossJoin(F.broadcast(cut)).withColumn("is_suspect", F.col("score") >= F.col("__cut")).drop("__cut")


def ranking_by_class(ranking: DataFrame) -> DataFrame:
    return ranking.groupBy("consumption_class").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("n_signals") > 0).alias("suspects"),
        F.sum("recoverable_kwh").alias("recoverable_kwh"),
        F.avg("score").alias("mean_score"),
    )


def multilevel_risk(
    ranking: DataFrame, site_risk: DataFrame, zone_confidence: DataFrame, *, site_weight: float = 0.35,
    min_confidence: float = 50.0,
) -> DataFrame:
    """Blend the customer score with its site's risk; low-confidence zones are scaled down.

    ``site_risk``: (site, site_risk); ``zone_confidence``: (zone, zone_confidence);
    ``ranking`` carries ``site`` and ``zone``.
    """
    p80 = exact_percentiles(ranking, [], "score", {"__p80": 0.80}).select("__p80")   # one row
    joined = attach(attach(ranking, site_risk, ["site"]), zone_confidence, ["zone"]).crossJoin(F.broadcast(p80))
    low = F.col("zone_confidence") < min_confidence
    blended = joined.withColumns({
        "site_risk": F.coalesce("site_risk", F.lit(0.0)),
        "zone_confidence": F.coalesce("zone_confidence", F.lit(100.0)),
    }).withColumn(
        "risk_score",
        F.round(
            ((1 - site_weight) * F.col("score") + site_weight * F.col("site_risk"))
            * F.when(low, F.col("zone_confidence") / 100.0).otherwise(F.lit(1.0)), 12
        ),
    ).withColumn("data_problem", low & (F.col("score") > F.col("__p80"))).drop("__p80")
    return global_rank(blended, [F.col("risk_score").desc(), F.col("account")], out="risk_rank")


def with_unit(ranking: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Business unit of each customer's feeder, blank when the feeder is not in the catalogue."""
    return ranking.join(hierarchy.select("feeder", "unit"), "feeder", "left").withColumn("unit", F.coalesce("unit", F.lit("")))
