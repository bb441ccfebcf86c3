"""Exact joins on ranges and distances without comparing every pair.

Intervals (or circles) are put on a grid whose cell is about as wide as they are,
so each touches a few cells whatever its size; points are looked up once per grid
level in use. The match is an equi-join on (keys, level, cell), which Spark
partitions by cell: one hot key or area is spread over its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _level(width: Column, floor_width: float) -> Column:
    """Smallest power of two not below ``width``, as its exponent."""
    return F.ceil(F.log2(F.greatest(width, F.lit(floor_width)))).cast("int")


def _levels(df: DataFrame, column: str) -> Column:
    """Array literal of the distinct levels in use: at most one per binary exponent."""
    found = sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None)
    return F.array(*[F.lit(v).cast("int") for v in found]) if found else F.array().cast("array<int>")


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], x: str, lo: str, hi: str
) -> DataFrame:
    """Pairs of equal ``keys`` with ``lo <= x <= hi``; other column names must differ.

    ``intervals`` may be read twice (once for its grid levels): pass a staged table.
    """
    span = points.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    if span is None or span["a"] is None:
        return points.join(intervals.where(F.lit(False)), list(keys))
    low, high = float(span["a"]), float(span["b"])
    least = max((high - low) * 2.0 ** -20, 1e-12)
    # Clipping to the points' range keeps an open interval finite.
    clipped = intervals.withColumns({
        "__lo": F.greatest(F.coalesce(F.col(lo), F.lit(low)), F.lit(low)),
        "__hi": F.least(F.coalesce(F.col(hi), F.lit(high)), F.lit(high)),
    }).where(F.col("__lo") <= F.col("__hi")).withColumn("__level", _level(F.col("__hi") - F.col("__lo"), least))
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("__level"))).cast("bigint")
    wide = clipped.withColumn("__cell", F.explode(F.sequence(cell(F.col("__lo")), cell(F.col("__hi")))))
    placed = points.withColumn("__level", F.explode(_levels(clipped, "__level"))).withColumn("__cell", cell(F.col(x)))
    inside = (F.col(x) >= F.col("__lo")) & (F.col(x) <= F.col("__hi"))
    return placed.join(wide, [*keys, "__level", "__cell"]).where(inside).drop("__level", "__cell", "__lo", "__hi")


def ball_join(points: DataFrame, balls: DataFrame, keys: Sequence[str], axes: Sequence[tuple[str, str]], radius: str) -> DataFrame:
    """Pairs of equal ``keys`` that no axis separates by more than ``radius``; other column names must differ.

    ``axes`` pairs a column of ``points`` with one of ``balls``. A ball touches two cells an axis at most. ``balls`` is
    read twice: pass a staged table. Rows with a null in an axis or the radius have no pairs.
    """
    levelled = balls.withColumn("__level", _level(2.0 * F.col(radius), 1e-6))
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("__level"))).cast("bigint")
    cells = [f"__c{i}" for i in range(len(axes))]
    wide, inside = levelled, F.lit(True)
    placed = points.withColumn("__level", F.explode(_levels(levelled, "__level")))
    for c, (x, centre) in zip(cells, axes):
        wide = wide.withColumn(c, F.explode(F.sequence(cell(F.col(centre) - F.col(radius)), cell(F.col(centre) + F.col(radius)))))
        placed = placed.withColumn(c, cell(F.col(x)))
        inside = inside & (F.abs(F.col(x) - F.col(centre)) <= F.col(radius))
    return placed.join(wide, [*keys, "__level", *cells]).where(inside).drop("__level", *cells)


def circle_join(
    points: DataFrame, circles: DataFrame, *, x: str = "x", y: str = "y", cx: str = "cx", cy: str = "cy",
    radius: str = "radius", distance: str = "distance",
) -> DataFrame:
    """Points within ``radius`` of each centre, with the distance."""
    d = F.sqrt((F.col(x) - F.col(cx)) * (F.col(x) - F.col(cx)) + (F.col(y) - F.col(cy)) * (F.col(y) - F.col(cy)))
    return (
        circle_candidates(points, circles, x=x, y=y, cx=cx, cy=cy, radius=radius)
        .withColumn(distance, d)
        .where(F.col(distance) <= F.col(radius))
    )


def circle_candidates(points: DataFrame, circles: DataFrame, *, x: str, y: str, cx: str, cy: str, radius: str) -> DataFrame:
    """Points in the cells that a circle meets: all within it, and fewer than as many again around it.

    A cell is a quarter to half a radius wide, so a circle meets some twenty to seventy, and the work follows the pairs that
    are found. Both sides are shuffled by cell: a broadcast would leave the pairs to the few tasks that read the points.
    """
    levelled = circles.withColumn("__level", _level(2.0 * F.col(radius), 1e-3) - 3)
    width = F.pow(F.lit(2.0), F.col("__level"))
    cell = lambda v: F.floor(v / width).cast("bigint")
    r = F.col(radius)
    # Distance of the centre from the nearest point of the cell along an axis.
    gap = lambda i, c: F.greatest(F.col(i) * width - F.col(c), F.col(c) - (F.col(i) + 1) * width, F.lit(0.0))
    wide = (
        levelled.withColumn("__i", F.explode(F.sequence(cell(F.col(cx) - r), cell(F.col(cx) + r))))
        .withColumn("__j", F.explode(F.sequence(cell(F.col(cy) - r), cell(F.col(cy) + r))))
        .where(F.sqrt(gap("__i", cx) * gap("__i", cx) + gap("__j", cy) * gap("__j", cy)) <= r * (1 + 1e-9) + width * 1e-6)
    )
    placed = (
        points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .withColumn("__level", F.explode(_levels(levelled, "__level")))
        .withColumns({"__i": cell(F.col(x)), "__j": cell(F.col(y))})
    )
    return placed.join(wide.hint("merge"), ["__level", "__i", "__j"]).drop("__level", "__i", "__j")


def nearest_within(
    points: DataFrame, vertices: DataFrame, *, point_id: str, vertex_id: str, tolerance: float = 3.0,
    vx: str = "vx", vy: str = "vy",
) -> DataFrame:
    """Closest vertex to each point within ``tolerance``; the smaller id wins a tie.

    Places are compared, not rows: of the vertices at one place only the smallest id can win, and points at one place have
    the same answer. Places look at the 3x3 cells around them, both sides shuffled by cell. Least ids per distance, then the
    least distance: two aggregations of plain numbers, which combine in hash tables before the shuffle and sort nothing.
    """
    side = lambda v: F.floor(v / F.lit(tolerance)).cast("bigint")
    around = F.array(*[F.lit(v).cast("bigint") for v in (-1, 0, 1)])
    asked = (
        points.select(F.col("x").alias("__x"), F.col("y").alias("__y")).distinct()
        .withColumn("__di", F.explode(around)).withColumn("__dj", F.explode(around))
        .select("__x", "__y", (side(F.col("__x")) + F.col("__di")).alias("__i"), (side(F.col("__y")) + F.col("__dj")).alias("__j"))
    )
    # A missing id comes first.
    least = F.when(~F.bool_or(F.col(vertex_id).isNull()), F.min(vertex_id)).alias(vertex_id)
    cells = vertices.groupBy(vx, vy).agg(least).withColumns({"__i": side(F.col(vx)), "__j": side(F.col(vy))})
    px, py = F.col("__x"), F.col("__y")
    d = F.sqrt((px - F.col(vx)) * (px - F.col(vx)) + (py - F.col(vy)) * (py - F.col(vy)))
    found = asked.join(cells.hint("merge"), ["__i", "__j"]).withColumn("distance", d).where(F.col("distance") <= tolerance)
    best = found.groupBy("__x", "__y", "distance").agg(least).groupBy("__x", "__y").agg(
        F.min_by(vertex_id, "distance").alias(vertex_id), F.min("distance").alias("distance"))
    # A point id with several places takes the best of them.
    return (
        points.select(point_id, "x", "y").join(best, (F.col("x") == px) & (F.col("y") == py))
        .groupBy(point_id, "distance").agg(least)
        .groupBy(point_id).agg(F.min_by(vertex_id, "distance").alias(vertex_id), F.min("distance").alias("distance"))
    )


def catalogue_nearest(items: DataFrame, catalogue: Sequence[dict], *, kva: str = "kva", phases: str = "phases",
                      cls: str = "voltage_class") -> DataFrame:
    """Catalogue entry with the nearest kVA: same phases and class, else same phases, else any.

    The catalogue is a short fixed list, so it travels as an array literal and the
    lookup is a projection. The earlier entry wins a tie.
    """
    entries = F.array(*[
        F.struct(*[F.lit(e[k]).alias(k) for k in e], F.lit(i).alias("ord")) for i, e in enumerate(catalogue)
    ])
    tier = lambda e: F.when((e["phases"] == F.col(phases)) & (e["cls"] == F.col(cls)), F.lit(0)).when(
        e["phases"] == F.col(phases), F.lit(1)
    ).otherwise(F.lit(2))
    ranked = F.array_min(F.transform(entries, lambda e: F.struct(
        tier(e).alias("tier"), F.abs(e["kva"] - F.col(kva)).alias("d"), e["ord"].alias("ord"), e.alias("entry"))))
    return items.withColumn("spec", ranked["entry"])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group; Spark keeps only ``k`` per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
