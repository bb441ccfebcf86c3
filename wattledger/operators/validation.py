"""The ranking measured against confirmed cases, signal calibration and PU learning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.operators.ranking import exact_percentiles, global_rank
from wattledger.params import SIGNALS
from wattledger.staging import stage


def load_confirmed(cases: DataFrame, cutoff: str | None = None) -> DataFrame:
    """One row per account, the last case by date; cases on or after ``cutoff`` would leak.

    Undated cases are kept and lose to dated ones.
    """
    d = cases
    if cutoff is not None:
        d = d.where(F.col("date").isNull() | (F.col("date") < F.lit(cutoff).cast("date")))
    order = F.struct(F.coalesce("date", F.lit("0001-01-01").cast("date")), "kwh", "kind")
    return d.groupBy(F.col("account").cast("string").alias("account")).agg(
        F.max_by(F.struct("date", "kwh", "kind"), order).alias("c"), F.count(F.lit(1)).alias("cases"),
    ).select("account", "c.date", "c.kwh", "c.kind", "cases")


def labelled_positions(ranking: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``(account, pos, hit)`` over the whole ranking, best score first."""
    hits = confirmed.select(F.col("account").cast("string").alias("__a")).distinct().withColumn("__h", F.lit(True))
    flagged = ranking.select("account", "score").join(hits, F.col("account").cast("string") == F.col("__a"), "left").select(
        "account", "score", F.col("__h").isNotNull().alias("hit"))
    return stage(global_rank(flagged, [F.col("score").desc(), F.col("account")], out="pos").select("account", "pos", "hit"), "positions")


def top_k_metrics(positions: DataFrame, ks: Sequence[float] = (1, 5, 10, 20)) -> DataFrame:
    """Precision, recall and lift in the best k % of the ranking, all k in one aggregate."""
    n_pos = positions.agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("p"))     # one row
    tops = n_pos.select("n", "p", F.explode(F.array(*[F.lit(float(k)) for k in ks])).alias("k_pct")).withColumn(
        "top", F.greatest(F.lit(1), F.bround(F.col("n") * F.col("k_pct") / 100.0)).cast("bigint"))
    # The tops are one small row, so each k is a conditional count of one pass over the positions.
    marks = tops.groupBy("n", "p").agg(F.map_from_entries(F.collect_list(F.struct("k_pct", "top"))).alias("tops"))
    found = positions.where("hit").crossJoin(F.broadcast(marks.select("tops"))).agg(*[
        F.count_if(F.col("pos") <= F.col("tops")[F.lit(float(k))]).alias(f"k{i}") for i, k in enumerate(ks)])
    by_k = found.select(F.explode(F.array(*[F.struct(F.lit(float(k)).alias("k_pct"), F.col(f"k{i}").alias("found")) for i, k in enumerate(ks)])).alias("e")).select("e.*")
    counted = tops.join(by_k, "k_pct")
    base = F.col("p") / F.col("n")
    return counted.where(F.col("p") > 0).select(
        "k_pct", "top", "found", (F.col("found") / F.col("top")).alias("precision"),
        (F.col("found") / F.col("p")).alias("recall"),
        (F.col("found") / F.col("top") / base).alias("lift"),
    )


def rank_quality(positions: DataFrame) -> DataFrame:
    """Median position of the confirmed (%), and AUC by rank sum."""
    s = positions.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("p"),
        F.sum(F.when(F.col("hit"), F.col("pos")).otherwise(F.lit(0))).alias("rank_sum"))
    med = exact_percentiles(positions.where("hit"), [], "pos", {"__m": 0.5}).select("__m")
    neg = F.col("n") - F.col("p")
    u = F.col("p") * neg + F.col("p") * (F.col("p") + 1) / 2 - F.col("rank_sum")
    return s.crossJoin(F.broadcast(med)).select(
        "n", F.col("p").alias("confirmed"), (F.col("p") / F.col("n")).alias("prevalence"),
        (F.col("__m") / F.col("n") * 100).alias("median_position_pct"),
        F.least(F.greatest(u / F.nullif(F.col("p") * neg, F.lit(0)), F.lit(0.0)), F.lit(1.0)).alias("auc"),
    )


def gain_by_decile(positions: DataFrame) -> DataFrame:
    n = positions.agg(F.count(F.lit(1)).alias("n"))      # one row
    i = F.col("pos") - 1
    decile = F.greatest(F.lit(1), F.ceil(10 * i / F.greatest(F.col("n") - 1, F.lit(1)))).cast("int")
    return positions.crossJoin(F.broadcast(n)).groupBy(decile.alias("decile")).agg(
        F.count(F.lit(1)).alias("customers"), F.count_if("hit").alias("confirmed"),
    ).withColumn("hit_rate_pct", F.round(F.col("confirmed") / F.col("customers") * 100, 2))


def calibrate_signals(signals: DataFrame, confirmed: DataFrame, names: Sequence[str] = SIGNALS) -> DataFrame:
    """Activation of each signal among confirmed and the rest, smoothed lift, recommendation."""
    hits = confirmed.select(F.col("account").cast("string").alias("__a")).distinct().withColumn("__h", F.lit(True))
    marked = signals.join(hits, F.col("account").cast("string") == F.col("__a"), "left").withColumn("hit", F.col("__h").isNotNull())
    # One aggregate over the wide matrix, unpivoted afterwards: rows are not multiplied.
    wide = marked.agg(
        F.count_if("hit").alias("p"), F.count_if(~F.col("hit")).alias("q"),
        *[F.count_if((F.coalesce(s, F.lit(0.0)) > 0) & F.col("hit")).alias(f"a_{s}") for s in names],
        *[F.count_if((F.coalesce(s, F.lit(0.0)) > 0) & ~F.col("hit")).alias(f"b_{s}") for s in names],
    )
    long = wide.where((F.col("p") > 0) & (F.col("q") > 0)).select("p", "q", F.inline(F.array(*[
        F.struct(F.lit(s).alias("signal"), F.col(f"a_{s}").alias("a"), F.col(f"b_{s}").alias("b")) for s in names])))
    lift = ((F.col("a") + 0.5) / (F.col("p") + 1.0)) / ((F.col("b") + 0.5) / (F.col("q") + 1.0))
    return long.select(
        "signal",
        F.round(F.col("a") / F.col("p") * 100, 2).alias("active_confirmed_pct"),
        F.round(F.col("b") / F.col("q") * 100, 2).alias("active_rest_pct"),
        F.col("a").alias("activations"),
        F.round(lift, 2).alias("lift"),
        F.when(lift > 2, "Aumentar peso").when(lift > 1.2, "Mantener")
        .otherwise("Revisar umbral o desactivar (no discrimina)").alias("recommendation"),
    )


#: Cuts of a feature's range at which the additive model may step.
PU_CUTS = (0.0, 0.25, 0.5, 0.75)


def pu_learning(
    features: DataFrame, confirmed: DataFrame, columns: Sequence[str], *, seed: int = 20260807, min_positives: int = 10,
    rounds: int = 25, ridge: float = 1.0,
) -> DataFrame:
    """``(account, pu_score, propensity)``: a labelled-against-unlabelled model, corrected by propensity.

    The model is additive: every feature has a level in each of five parts of its range, cut as boosted stumps would. From
    the share of positives on, the levels are fitted by a fixed number of Newton steps; at most one level a feature is
    active in a row, so a step of one part in (features + 1) cannot overshoot. Customers with the same steps and label are one weighted row (at most five
    to the number of features), so a round is an aggregate over few rows, whatever the number of customers. The hold-out is
    a hash of the account within each label, so it does not depend on partitioning. With too few positives every score is
    zero; the propensity is the mean over held-out positives, at least a thousandth.
    """
    hits = confirmed.select(F.col("account").cast("string").alias("__a")).distinct().withColumn("__h", F.lit(True))
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    limits = features.agg(*[f(value[c]).alias(f"__{t}{i}") for i, c in enumerate(columns) for f, t in ((F.min, "lo"), (F.max, "hi"))])
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("account").cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long")
    steps = []
    for i, c in enumerate(columns):
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        scaled = F.when(hi > lo, (value[c] - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(0.0)
        steps.append(sum((F.when(scaled > cut, 1).otherwise(0) for cut in PU_CUTS), F.lit(0)).alias(f"f{i}"))
    levels = [f"f{i}" for i in range(len(columns))]
    data = stage(features.join(hits, F.col("account").cast("string") == F.col("__a"), "left").crossJoin(F.broadcast(limits)).select(
        "account", *steps, F.col("__h").isNotNull().cast("int").alias("label"), (draw % 10 < 3).alias("held_out")), "pu")
    patterns = stage(data.groupBy(*levels, "label", "held_out").agg(F.count(F.lit(1)).alias("n")), "patterns")
    positives = patterns.agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0))).first()[0] or 0
    if positives < min_positives:
        return data.select("account", F.lit(0.0).alias("pu_score"), F.lit(1.0).alias("propensity"))
    fitted = patterns.where(~F.col("held_out"))
    units = [("bias", F.lit(1.0)), *[(f"{f}_{j}", F.when(F.col(f) == j, 1.0).otherwise(0.0)) for f in levels for j in range(1, len(PU_CUTS) + 1)]]
    known, total = fitted.agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)), F.sum("n")).first()
    weight = {name: 0.0 for name, _ in units} | {"bias": math.log((known + 1.0) / (total - known + 1.0))}

    def chance() -> Column:
        z = sum((F.lit(weight[name]) * x for name, x in units[1:]), F.lit(weight["bias"]))
        return 1.0 / (1.0 + F.exp(-z))

    for _ in range(rounds):
        p, n = chance(), F.col("n")
        # Gradient and curvature of every step: a bounded number of sums.
        sums = fitted.withColumn("__p", p).agg(*[
            e for name, x in units for e in (F.sum(n * (F.col("__p") - F.col("label")) * x).alias(f"g_{name}"), F.sum(n * F.col("__p") * (1 - F.col("__p")) * x).alias(f"h_{name}"))]).first()
        weight = {name: w - (sums[f"g_{name}"] + ridge * w) / (sums[f"h_{name}"] + ridge) / (len(columns) + 1) for name, w in weight.items()}
    scored = stage(patterns.withColumn("p", chance()), "pu")
    held = scored.where(F.col("held_out") & (F.col("label") == 1)).agg((F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("c"))
    c = held.select(F.least(F.greatest(F.coalesce("c", F.lit(1.0)), F.lit(1e-3)), F.lit(1.0)).alias("propensity"))
    by_step = scored.select(*levels, "p").distinct()
    return data.join(by_step, levels).crossJoin(F.broadcast(c)).select(
        "account", F.least(F.greatest(F.col("p") / F.col("propensity"), F.lit(0.0)), F.lit(1.0)).alias("pu_score"), "propensity")
