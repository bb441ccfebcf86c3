"""Entities judged against structurally similar ones (exact block-local k-nearest peers)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions import arrays as A
from wattledger.operators.rangejoin import ball_join, top_per_group
from wattledger.operators.ranking import attach, exact_percentiles_of, global_rank
from wattledger.staging import stage

MAD = 1.4826
#: Axes of the grid in which peers are looked for: a ball touches 2 cells an axis.
GRID_AXES = 3

# Profile and block columns by level. None derives from the metric.
LEVEL_PROFILES: dict[str, dict[str, list[str]]] = {
    "ALIMENTADOR": {"profile": ["customers", "energy_kwh", "network_km", "transformers", "kva", "pct_residential", "kwh_per_customer"],
                    "block": ["unit"]},
    "RAMAL": {"profile": ["customers", "energy_kwh", "network_km", "kwh_per_customer"], "block": ["feeder"]},
    "PUESTO_TRANSFORMACION": {"profile": ["customers", "energy_kwh", "kva", "kwh_per_customer", "pct_residential"], "block": ["feeder"]},
    "RUTA_COMERCIAL": {"profile": ["customers", "energy_kwh", "kwh_per_customer", "pct_residential"], "block": ["unit"]},
    "SECTOR": {"profile": ["customers", "energy_kwh", "kwh_per_customer", "radius_m"], "block": ["feeder"]},
}


def usable_profile(columns: Sequence[str], profile: Sequence[str], metric: str) -> tuple[list[str], list[str]]:
    """Profile columns that exist and are not the metric, and the circular ones left out.

    Looking for peers by the very metric under test makes nothing look odd.
    """
    circular = [c for c in profile if c == metric]
    usable = [c for c in profile if c in columns and c != metric]
    if not usable:
        raise ValueError("no profile column left to define similarity")
    return usable, circular


def robust_scale(df: DataFrame, profile: Sequence[str], *, sample_std: bool = True) -> DataFrame:
    """Add ``z_<column>``: median fill, then (x - median) / MAD, else / deviation, else / 1."""
    med = stage(exact_percentiles_of(df, [], {c: {f"m_{c}": 0.5} for c in profile}), "medians")
    filled = df.crossJoin(F.broadcast(med.select(*[f"m_{c}" for c in profile]))).select(    # one row
        *df.columns, *[f"m_{c}" for c in profile],
        *[F.coalesce(F.col(c).cast("double"), F.col(f"m_{c}")).alias(f"x_{c}") for c in profile])
    filled = stage(filled, "filled")
    gaps = filled.select(*[F.abs(F.col(f"x_{c}") - F.col(f"m_{c}")).alias(c) for c in profile])
    mad = exact_percentiles_of(gaps, [], {c: {f"d_{c}": 0.5} for c in profile}).select(*[f"d_{c}" for c in profile])
    std = filled.agg(*[F.stddev_samp(f"x_{c}").alias(f"s_{c}") for c in profile])
    scales = stage(mad.crossJoin(std), "scales")                                             # one row
    out = filled.crossJoin(F.broadcast(scales))
    fallback = lambda c: F.coalesce(F.nullif(f"s_{c}", F.lit(0.0)), F.lit(1.0)) if sample_std else F.lit(1.0)
    z = [
        ((F.col(f"x_{c}") - F.col(f"m_{c}")) / F.coalesce(F.nullif(MAD * F.col(f"d_{c}"), F.lit(0.0)), fallback(c))).alias(f"z_{c}")
        for c in profile
    ]
    return out.select(*df.columns, *z)


def _distance(a: str, b: str, n: int) -> Column:
    return F.sqrt(sum(
        ((F.col(f"{a}{i}") - F.col(f"{b}{i}")) * (F.col(f"{a}{i}") - F.col(f"{b}{i}")) for i in range(1, n)),
        (F.col(f"{a}0") - F.col(f"{b}0")) * (F.col(f"{a}0") - F.col(f"{b}0")),
    ))


def z_order(df: DataFrame, axes: Sequence[str]) -> Column:
    """Place on a Z-order curve over the range of ``axes``: rows with near places are mostly near on all axes."""
    bits = min(16, 60 // len(axes))
    span = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(axes) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = F.lit(0).cast("bigint")
    for i, c in enumerate(axes):
        lo, width = span[f"lo{i}"], (span[f"hi{i}"] or 0.0) - (span[f"lo{i}"] or 0.0)
        if width > 0:
            step = F.coalesce(F.least(F.floor((F.col(c) - lo) / width * 2 ** bits), F.lit(2 ** bits - 1)).cast("bigint"), F.lit(0))
            for k in range(bits):
                out = out + F.shiftleft(F.shiftright(step, k).bitwiseAND(1), k * len(axes) + i)
    return out


def nearest_peers(scaled: DataFrame, zs: Sequence[str], k: int, *, entity: str, block: str) -> DataFrame:
    """Exact k nearest peers inside a block: ``(entity, peer, distance)``.

    ``scaled`` has one row per (entity, block) with a boolean ``asks``. First each
    asking row measures its k neighbours on either side along a Z-order curve over
    all axes; the k-th smallest distance bounds the answer. Every true neighbour lies
    within that bound on every axis, so a join of grid cells over the first
    ``GRID_AXES`` axes finds them all, also where one of them has few values. No
    block is compared pair by pair, and a large block is spread over the cells.
    """
    candidates = peer_candidates(scaled, zs, k, entity=entity, block=block)
    ranked = top_per_group(candidates, ["blk", "e"], [F.col("distance"), F.col("peer")], k)
    return ranked.select(F.col("e").alias(entity), "peer", "distance", F.col("__rn").alias("position"))


def peer_candidates(scaled: DataFrame, zs: Sequence[str], k: int, *, entity: str, block: str) -> DataFrame:
    """``blk, e, peer, distance``: what ``nearest_peers`` ranks, the k nearest of every asking row among them."""
    n = len(zs)
    axes = [f"a{i}" for i in range(n)]
    rows = stage(scaled.select(F.col(entity).alias("e"), F.col(block).alias("blk"), "asks", *[F.col(z).alias(a) for a, z in zip(axes, zs)]), "peers")
    # Positions along the curve inside each block, in one distributed pass.
    placed = stage(global_rank(rows.withColumn("z", z_order(rows, axes)), [F.col("z"), F.col("e")], partition=["blk"], out="pos").drop("z"), "curve")
    other = placed.select("blk", "pos", F.col("e").alias("peer"), *[F.col(a).alias(f"b{i}") for i, a in enumerate(axes)])
    offsets = F.array(*[F.lit(o).cast("bigint") for o in range(-k, k + 1) if o])
    near = (
        placed.where("asks").withColumn("pos", F.explode(F.transform(offsets, lambda o: o + F.col("pos"))))
        .join(other, ["blk", "pos"])
        .withColumn("d", _distance("a", "b", n)).where("d is not null and peer <> e")
    )
    bounds = near.groupBy("blk", "e").agg(F.array_sort(F.collect_list(F.struct(F.col("d").alias("distance"), "peer"))).alias("ds"))   # at most 2k each
    asking = stage(placed.where("asks").drop("asks", "pos").join(bounds, ["blk", "e"]).withColumns({
        # A hair wider, so that rounding cannot lose a neighbour at the bound.
        "radius": F.get("ds", F.lit(k - 1))["distance"] * (1 + 1e-9) + 1e-9}), "asking")
    grid = [(f"b{i}", f"a{i}") for i in range(min(n, GRID_AXES))]
    pairs = ball_join(other.drop("pos"), asking.where("radius is not null").drop("ds"), ["blk"], grid, "radius").where(F.col("peer") != F.col("e"))
    # A block of fewer than k others was met whole.
    few = asking.where("radius is null").select("blk", "e", F.inline("ds")).select("blk", "e", "peer", "distance")
    return pairs.withColumn("distance", _distance("a", "b", n)).where(F.col("distance") <= F.col("radius")).select("blk", "e", "peer", "distance").unionAll(few)


def _blocks(d: DataFrame, block: Sequence[str], entity: str, min_block: int) -> DataFrame:
    """One row per (entity, block) it belongs to; small blocks ask the whole universe."""
    usable = [c for c in block if c in d.columns]
    if not usable:
        return d.withColumns({"blk": F.lit("*"), "asks": F.lit(True)})
    keyed = d.withColumn("blk", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in usable]))
    sizes = keyed.groupBy("blk").agg(F.count(F.lit(1)).alias("__n"))
    sized = stage(attach(keyed, sizes, ["blk"], "inner"), "blocks")
    small = F.col("__n") < min_block
    own = sized.where(~small).withColumn("asks", F.lit(True))
    if sized.where(small).limit(1).count() == 0:
        return own.drop("__n")
    everyone = sized.withColumns({"blk": F.lit("*"), "asks": small})
    return own.unionByName(everyone).drop("__n")


def compare_with_peers(
    entities: DataFrame, *, entity: str, metric: str, profile: Sequence[str], block: Sequence[str] = (),
    k: int = 8, minimum: int = 4, z_min: float = 3.0, min_block: int = 5,
) -> DataFrame:
    """Entities whose metric departs from that of their structural peers by ``z_min`` or more."""
    usable, _ = usable_profile(entities.columns, profile, metric)
    d = entities.where(F.col(metric).isNotNull()).withColumn(entity, F.col(entity).cast("string"))
    scaled = stage(robust_scale(d, usable), "scaled")
    zs = [f"z_{c}" for c in usable]
    wanted = max(k, minimum)
    peers = nearest_peers(_blocks(scaled, block, entity, min_block), zs, wanted, entity=entity, block="blk")
    values = scaled.select(F.col(entity).alias("peer"), F.col(metric).cast("double").alias("__value"))
    grouped = peers.join(values, "peer").groupBy(entity).agg(
        F.array_sort(F.collect_list(F.struct("position", "distance", "__value", "peer"))).alias("p"))   # at most k
    admitted = (
        grouped.where(F.size("p") >= minimum)
        .withColumn("__ref", F.expr(A.median_sorted(f"transform(slice(p, 1, {minimum}), e -> e.distance)")))
        .withColumn("__in", F.expr(f"filter(slice(p, 1, {k}), e -> e.distance <= 3D * __ref)"))
        .withColumn("__used", F.expr(
            f"if(size(p) <= {minimum}, p, if(__ref <= 0, p, if(size(__in) >= {minimum}, __in, slice(p, 1, {minimum}))))"))
        .withColumn("__v", F.expr("array_sort(transform(__used, e -> e.__value))"))
        .withColumn("expected", F.expr(A.median_sorted("__v")))
        .withColumn("__mad", F.expr(f"{MAD}D * {A.median_sorted('array_sort(transform(__v, x -> abs(x - expected)))')}"))
        .withColumn("__disp", F.greatest(F.col("__mad"), 0.10 * F.abs("expected")))
    )
    own = scaled.select(entity, F.col(metric).cast("double").alias("observed"))
    z = (F.col("observed") - F.col("expected")) / F.nullif("__disp", F.lit(0.0))
    return (
        admitted.join(own, entity).withColumn("robust_z", z).where(F.abs("robust_z") >= z_min)
        .select(
            entity, "observed", "expected", (F.col("observed") - F.col("expected")).alias("deviation"), "robust_z",
            F.size("__used").alias("n_peers"), F.expr("transform(slice(__used, 1, 5), e -> e.peer)").alias("peers"),
            F.when(F.abs("robust_z") >= 4.5, "ALTA").otherwise("MEDIA").alias("severity"),
        )
    )


def most_similar(entities: DataFrame, target, *, entity: str, profile: Sequence[str], k: int = 8) -> DataFrame:
    """The ``k`` entities closest to ``target`` and the target itself, by structural distance."""
    scaled = stage(robust_scale(entities, profile, sample_std=False), "scaled")
    mine = scaled.where(F.col(entity) == target).limit(1).select(*[F.col(f"z_{c}").alias(f"t_{c}") for c in profile])
    sq = sum(((F.col(f"z_{c}") - F.col(f"t_{c}")) * (F.col(f"z_{c}") - F.col(f"t_{c}")) for c in profile), F.lit(0.0))
    return (
        scaled.crossJoin(F.broadcast(mine)).withColumn("distance", F.sqrt(sq))      # one row
        .orderBy("distance", entity).limit(k + 1)
        .select(*entities.columns, "distance")
    )
