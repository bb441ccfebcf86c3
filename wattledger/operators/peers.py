"""Segment summaries, peer groups, expected and recoverable energy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattledger.operators.ranking import attach, exact_percentiles, global_rank
from wattledger.params import PEER_LEVELS
from wattledger.staging import stage


def assign_peer_group(
    customers: DataFrame,
    min_peers: int = 8,
    levels: Sequence[tuple[str, Sequence[str], float]] = PEER_LEVELS,
) -> DataFrame:
    """Finest peer group with at least ``min_peers`` members still unplaced.

    Whether a customer is placed depends only on its key values, so the cascade
    runs on the distinct key combinations with their counts (classes x voltages x
    phases x routes), not on customers, and the customers are joined once.
    ``customers`` is read twice: pass a staged table.
    """
    keys = list(dict.fromkeys(k for _, cols, _ in levels for k in cols))
    usable = [lv for lv in levels if all(c in customers.columns for c in lv[1])]
    keys = [k for k in keys if k in customers.columns]
    combos = customers.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    combos = combos.withColumns({
        "peer_group": F.lit(None).cast("string"), "peer_level": F.lit(None).cast("string"),
        "peer_confidence": F.lit(0.0), "peer_n": F.lit(0).cast("bigint"),
    })
    for name, cols, confidence in usable:
        open_ = F.col("peer_group").isNull()
        for c in cols:
            open_ = open_ & F.col(c).isNotNull()
        label = F.concat(F.lit(f"{name}::"), F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))
        take = open_ & (F.col("__size") >= min_peers)
        # Only still-unplaced combinations count towards a level.
        sized = combos.withColumn("__size", F.sum(F.when(open_, F.col("__c"))).over(Window.partitionBy(*cols)))
        combos = sized.select(
            *keys, "__c",
            F.when(take, label).otherwise(F.col("peer_group")).alias("peer_group"),
            F.when(take, F.lit(name)).otherwise(F.col("peer_level")).alias("peer_level"),
            F.when(take, F.lit(confidence)).otherwise(F.col("peer_confidence")).alias("peer_confidence"),
            F.when(take, F.col("__size")).otherwise(F.col("peer_n")).alias("peer_n"),
        )
    renamed = stage(combos.drop("__c"), "peers")
    cond = F.lit(True)
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__k_{k}")
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return customers.join(renamed, cond, "left").drop(*[f"__k_{k}" for k in keys])


def peer_level_summary(customers: DataFrame) -> DataFrame:
    g = customers.groupBy("peer_level").agg(
        F.count(F.lit(1)).alias("customers"),
        F.max("peer_confidence").alias("confidence"),
        F.avg("peer_n").alias("mean_size"),
    )
    total = customers.agg(F.count(F.lit(1)).alias("__t"))   # one row
    return g.crossJoin(F.broadcast(total)).select(
        "peer_level", "customers", "confidence",
        F.round("mean_size", 1).alias("mean_size"),
        F.round(F.col("customers") / F.col("__t") * 100, 1).alias("pct"),
    )


def segment_summary(customers: DataFrame, by: str) -> DataFrame:
    """Customers and base energy by ``by`` with their share of the totals.

    Groups are few, so the share is taken over the grouped rows.
    """
    g = customers.groupBy(by).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(F.coalesce("base_kwh", F.lit(0.0))).alias("base_kwh_month"),
    )
    totals = g.agg(F.sum("customers").alias("__c"), F.sum("base_kwh_month").alias("__e"))
    return g.crossJoin(F.broadcast(totals)).select(
        by, "customers", "base_kwh_month",
        F.round(F.col("customers") / F.col("__c") * 100, 2).alias("pct_customers"),
        F.round(F.coalesce(F.col("base_kwh_month") / F.nullif("__e", F.lit(0.0)) * 100, F.lit(0.0)), 2).alias("pct_energy"),
    )


def segmentation_coverage(customers: DataFrame) -> DataFrame:
    known = F.col("consumption_class") != "NO_CLASIFICADO"
    base = F.coalesce("base_kwh", F.lit(0.0))
    return customers.agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum((~known).cast("bigint")).alias("unclassified"),
        (F.avg(known.cast("double")) * 100).alias("coverage_pct"),
        F.coalesce(
            F.sum(F.when(F.col("consumption_class") != "RESIDENCIAL", base).otherwise(F.lit(0.0)))
            / F.nullif(F.sum(base), F.lit(0.0)) * 100, F.lit(0.0)
        ).alias("non_residential_energy_pct"),
    )


def expected_by_group(df: DataFrame, kwh: str = "avg_kwh", statistic: str = "median") -> DataFrame:
    """``(peer_group, expected_kwh)``: exact median (or mean) of each peer group."""
    grouped = df.where(F.col("peer_group").isNotNull())
    if statistic == "mean":
        return grouped.groupBy("peer_group").agg(F.avg(kwh).alias("expected_kwh"))
    return exact_percentiles(grouped, ["peer_group"], kwh, {"expected_kwh": 0.5}).drop("n")


def with_expected(df: DataFrame, kwh: str = "avg_kwh", statistic: str = "median") -> DataFrame:
    return attach(df, expected_by_group(df, kwh, statistic), ["peer_group"])


def recoverable(actual: Column, expected: Column, base: Column) -> Column:
    """Larger of the drop against itself and the deficit against its peers, never negative."""
    zero = F.lit(0.0)
    return F.greatest(F.coalesce(base - actual, zero), F.coalesce(expected - actual, zero), zero)


def yield_per_visit(
    ranking: DataFrame, segment: str = "consumption_class", top_pct: float = 5.0, visit_cost: float = 1.0
) -> DataFrame:
    """Energy per visit when the best ``top_pct`` of each segment is inspected."""
    ranked = global_rank(
        ranking.select(segment, "account", "score", F.coalesce("recoverable_kwh", F.lit(0.0)).alias("rec")),
        [F.col("score").desc(), F.col("account")], partition=[segment], out="pos",
    )
    sizes = ranking.groupBy(segment).agg(F.count(F.lit(1)).alias("customers")).withColumn(
        "visits", F.greatest(F.lit(1), F.bround(F.col("customers") * F.lit(top_pct) / 100.0)).cast("bigint")
    )
    top = F.col("pos") <= F.col("visits")
    g = attach(ranked, sizes, [segment], "inner").groupBy(segment, "customers", "visits").agg(
        F.sum(F.when(top, F.col("rec"))).alias("top_kwh"),
        F.avg(F.when(top, F.col("score"))).alias("mean_score_top"),
        F.sum("rec").alias("total_kwh"),
    )
    return g.withColumn("kwh_per_visit", F.col("top_kwh") / F.greatest(F.col("visits") * F.lit(visit_cost), F.lit(1e-9)))


def concentration(ranking: DataFrame) -> DataFrame:
    """Share of customers and of recoverable energy outside the residential class."""
    other = F.col("consumption_class") != "RESIDENCIAL"
    rec = F.coalesce("recoverable_kwh", F.lit(0.0))
    return ranking.agg(
        (F.avg(other.cast("double")) * 100).alias("pct_customers_non_residential"),
        (F.sum(F.when(other, rec).otherwise(F.lit(0.0))) / F.nullif(F.sum(rec), F.lit(0.0)) * 100).alias(
            "pct_recoverable_non_residential"
        ),
    ).withColumn(
        "dedicated_crew",
        F.col("pct_recoverable_non_residential") > F.col("pct_customers_non_residential") * 1.5,
    )


def large_customers(ranking: DataFrame, top: int = 25, min_score: float = 0.0) -> DataFrame:
    """Large customers with any indication, by energy at stake (top-k report)."""
    hint = (F.coalesce("n_signals", F.lit(0)) > 0) | (F.coalesce("recoverable_kwh", F.lit(0.0)) > 0)
    return (
        ranking.where(F.coalesce("is_large", F.lit(False)) & (F.col("score") >= min_score) & hint)
        .orderBy(F.col("recoverable_kwh").desc(), F.col("score").desc(), "account")
        .limit(top)
        .withColumn("action", F.lit("Verificación individual de medición y contraste de demanda"))
    )
