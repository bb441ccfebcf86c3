"""Field targets by level, sectors, locations and work orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.operators.ranking import exact_percentiles
from wattledger.staging import stage

W_SUSPICION, W_ENERGY = 0.55, 0.45
COLUMNS = ["level", "entity", "feeder", "priority", "suspicion", "kwh", "customers", "network_km", "confidence",
           "data_problem", "reasons", "x", "y"]


def with_norm(df: DataFrame, **columns: str) -> DataFrame:
    """Add ``out = min-max(column)`` over the whole level; a constant gives 1 if positive, else 0.

    ``df`` is read twice (once for the one-row limits): pass a staged table.
    """
    safe = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    aggs = [f(safe(c)).alias(f"__{t}_{o}") for o, c in columns.items() for f, t in ((F.min, "lo"), (F.max, "hi"))]
    out = df.crossJoin(F.broadcast(df.agg(*aggs)))
    for o, c in columns.items():
        lo, hi = F.col(f"__lo_{o}"), F.col(f"__hi_{o}")
        out = out.withColumn(o, F.when(hi - lo < 1e-12, F.when(safe(c) > 0, 1.0).otherwise(0.0)).otherwise(
            (safe(c) - lo) / F.nullif(hi - lo, F.lit(0.0))))
    return out.drop(*[f"__{t}_{o}" for o in columns for t in ("lo", "hi")])


def clip(v: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def priority(suspicion: Column, energy_norm: Column, confidence: Column, need_suspicion: bool = False) -> Column:
    """Suspicion and energy blended, scaled down by low confidence and, if asked, without any sign."""
    s = clip(suspicion)
    base = W_SUSPICION * s + W_ENERGY * energy_norm
    if need_suspicion:
        base = F.when(s > 0, base).otherwise(base * 0.15)
    return clip(base * clip(confidence / 100.0, 0.2, 1.0))


def qualified_id(entity: Column, feeder: Column, default: str = "") -> Column:
    """``feeder/entity`` unless the entity already starts with its feeder."""
    e = F.coalesce(F.nullif(entity.cast("string"), F.lit("")), F.lit(default))
    f = F.trim(F.coalesce(feeder, F.lit("")))
    return F.when((f == "") | e.startswith(f), e).otherwise(F.concat_ws("/", f, e))


def _target(df: DataFrame, level: str, **cols: Column) -> DataFrame:
    defaults = dict(feeder=F.lit(None).cast("string"), customers=F.lit(0), network_km=F.lit(0.0), confidence=F.lit(100.0),
                    data_problem=F.lit(False), reasons=F.array().cast("array<string>"), x=F.lit(None).cast("double"), y=F.lit(None).cast("double"))
    types = dict(customers="bigint", network_km="double", confidence="double", x="double", y="double", priority="double", suspicion="double", kwh="double")
    every = {"level": F.lit(level), **defaults, **cols}
    return df.select(*[every[c].cast(types[c]).alias(c) if c in types else every[c].alias(c) for c in COLUMNS])


def _or(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def _compact(*reasons: Column) -> Column:
    return F.slice(F.filter(F.array(*reasons), lambda r: r.isNotNull()), 1, 3)


def feeder_targets(b: DataFrame, min_confidence: float = 50.0) -> DataFrame:
    """``b``: feeder, ntl_pct, ntl_kwh, balance_type and optionally confidence, customers, network_km."""
    b = with_norm(stage(b, "targets"), s="ntl_pct", e="ntl_kwh")
    conf = _or(b, "confidence", F.lit(100.0))
    return _target(
        b, "ALIMENTADOR", entity=F.col("feeder"), feeder=F.col("feeder"), suspicion=F.col("s"),
        priority=priority(F.col("s"), F.col("e"), conf), kwh=F.coalesce("ntl_kwh", F.lit(0.0)), confidence=conf,
        customers=_or(b, "customers", F.lit(0)), network_km=_or(b, "network_km", F.lit(0.0)), data_problem=conf < min_confidence,
        reasons=_compact(
            F.format_string("PNT del alimentador %.1f%% de la energía de entrada", F.coalesce("ntl_pct", F.lit(0.0))),
            F.when(F.col("balance_type") == "INDICATIVO", F.lit("Balance INDICATIVO: sin medición de cabecera")),
            F.when(conf < min_confidence, F.lit("Baja confiabilidad del modelo: revisar datos primero"))))


def zone_targets(z: DataFrame) -> DataFrame:
    """``z``: zone, feeder, signal, residual_kwh, customers, network_km, confidence."""
    z = with_norm(stage(z, "targets"), e="residual_kwh")
    return _target(
        z, "ZONA_PROTECCION", entity=qualified_id(F.col("zone"), F.col("feeder"), "Z"), feeder=F.col("feeder"),
        suspicion=F.col("signal"), priority=priority(F.col("signal"), F.col("e"), F.col("confidence")), kwh=F.col("residual_kwh"),
        customers=F.col("customers"), network_km=_or(z, "network_km", F.lit(0.0)), confidence=F.col("confidence"),
        reasons=F.array(F.lit("Zona aislable: candidata a medición de frontera")))


def branch_targets(b: DataFrame, min_customers: int = 3) -> DataFrame:
    """``b``: branch, feeder, customers, suspects, recoverable_kwh, network_km. Single drops are left out."""
    b = with_norm(stage(b.where(F.col("customers") >= max(1, min_customers)), "targets"), s="suspects", e="recoverable_kwh")
    n = F.greatest("customers", F.lit(1))
    susp = clip(0.5 * clip(F.col("suspects") / n) + 0.5 * F.col("s"))
    return _target(
        b, "RAMAL", entity=qualified_id(F.col("branch"), F.col("feeder"), "R"), feeder=F.col("feeder"), suspicion=susp,
        priority=priority(susp, F.col("e"), F.lit(100.0), need_suspicion=True), kwh=F.col("recoverable_kwh"),
        customers=F.col("customers"), network_km=_or(b, "network_km", F.lit(0.0)),
        reasons=F.array(F.when(F.col("suspects") > 0, F.format_string("%d de %d clientes del ramal con señal de PNT", F.col("suspects").cast("long"), F.col("customers").cast("long")))
                        .otherwise(F.lit("Sin señales de PNT en el ramal: prioridad residual"))))


def site_targets(t: DataFrame, min_confidence: float = 50.0) -> DataFrame:
    """``t``: site, feeder, customers, suspects, recoverable_kwh, totaliser_residual_kwh, loading_ratio."""
    t = with_norm(stage(t, "targets"), r="totaliser_residual_kwh", e="recoverable_kwh")
    n = F.greatest("customers", F.lit(1))
    susp = clip(0.45 * clip(F.col("suspects") / n) + 0.35 * F.col("r") + 0.20 * clip((0.30 - F.col("loading_ratio")) / 0.30))
    conf = _or(t, "confidence", F.lit(100.0))
    return _target(
        t, "PUESTO_TRANSFORMACION", entity=qualified_id(F.col("site"), F.col("feeder"), "TS"), feeder=F.col("feeder"), suspicion=susp,
        priority=priority(susp, F.col("e"), conf), kwh=F.col("recoverable_kwh"), customers=n, confidence=conf, data_problem=conf < min_confidence,
        network_km=_or(t, "network_km", F.lit(0.0)), x=_or(t, "x", F.lit(None)), y=_or(t, "y", F.lit(None)),
        reasons=_compact(
            F.when(F.col("suspects") > 0, F.lit("Clientes del transformador con señal de PNT")),
            F.when(F.col("totaliser_residual_kwh") > 0, F.lit("Balance de totalizador: diferencia frente a los medidores individuales")),
            F.when(F.col("loading_ratio") < 0.30, F.lit("Cargabilidad incoherente"))))


def route_statistics(customers: DataFrame, *, min_customers: int = 5, zeros_pct: float = 20.0, estimated_pct: float = 30.0) -> DataFrame:
    """Diagnostics per reading route.

    ``customers``: account, route, kwh, suspect, recoverable_kwh, zero_share,
    estimated_share, unlinked. Components enter the incoherence only when triggered.
    """
    c = stage(customers.where(F.col("route").isNotNull()), "routes")
    median = exact_percentiles(c, [], "kwh", {"__med": 0.5}).select("__med")       # one row
    g = c.groupBy("route").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if("suspect").alias("suspects"), F.sum("kwh").alias("energy_kwh"),
        F.sum(F.coalesce("recoverable_kwh", F.lit(0.0))).alias("recoverable_kwh"), (F.avg("zero_share") * 100).alias("zero_pct"),
        (F.avg("estimated_share") * 100).alias("estimated_pct"), F.avg("kwh").alias("__mean"), F.stddev_samp("kwh").alias("__sd"),
        F.count_if("unlinked").alias("unlinked")).where(F.col("customers") >= min_customers)
    med = F.coalesce(F.nullif("__med", F.lit(0.0)), F.lit(1.0))
    rows = g.crossJoin(F.broadcast(median)).withColumns({
        "cv": F.when(F.col("__mean") > 0, F.col("__sd") / F.col("__mean")).otherwise(0.0),
        "ratio": F.when(med > 0, F.col("__mean") / med).otherwise(1.0),
        "density": F.col("suspects") / F.col("customers"),
    })
    parts = F.filter(F.array(
        F.when(F.col("zero_pct") > zeros_pct, F.least(F.col("zero_pct") / 100.0, F.lit(1.0))),
        F.when(F.col("estimated_pct") > estimated_pct, F.least(F.col("estimated_pct") / 100.0, F.lit(1.0))),
        F.when(F.col("ratio") < 0.6, F.least((0.6 - F.col("ratio")) / 0.6, F.lit(1.0))),
        F.when(F.col("unlinked") > 0, F.least(F.col("unlinked") / F.col("customers"), F.lit(1.0)))), lambda v: v.isNotNull())
    notes = _compact(
        F.when(F.col("suspects") > 0, F.lit("Clientes de la ruta con señal de PNT")),
        F.when(F.col("zero_pct") > zeros_pct, F.lit("Lecturas en cero en la ruta")),
        F.when(F.col("estimated_pct") > estimated_pct, F.lit("Lecturas estimadas: la ruta no se está leyendo")),
        F.when(F.col("ratio") < 0.6, F.lit("Nivel colapsado frente a sus pares")),
        F.when(F.col("unlinked") > 0, F.lit("Clientes que facturan sin estar en el SIG")))
    return rows.withColumn("__p", parts).withColumns({
        "incoherence": F.when(F.size("__p") > 0, clip(F.aggregate("__p", F.lit(0.0), lambda a, v: a + v) / F.size("__p"))).otherwise(0.0),
        "reasons": notes,
    }).drop("__p", "__mean", "__sd", "__med")


def route_targets(r: DataFrame) -> DataFrame:
    r = with_norm(stage(r, "targets"), s="suspects", e="recoverable_kwh")
    susp = clip(F.greatest(0.5 * clip(F.col("suspects") / F.greatest("customers", F.lit(1))) + 0.5 * F.col("s"), F.col("incoherence")))
    return _target(
        r, "RUTA_COMERCIAL", entity=F.col("route"), suspicion=susp, priority=priority(susp, F.col("e"), F.lit(100.0)),
        kwh=F.col("recoverable_kwh"), customers=F.col("customers"),
        reasons=F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("Ruta priorizada por concentración de señales"))))


def customer_targets(ranking: DataFrame, top: int = 200) -> DataFrame:
    """The best ``top`` customers of the ranking (a top-k report)."""
    c = with_norm(stage(ranking.orderBy("rank").limit(top), "targets"), e="recoverable_kwh")
    return _target(
        c, "CLIENTE", entity=F.col("account").cast("string"), feeder=F.col("feeder"), suspicion=F.col("score"),
        priority=priority(F.col("score"), F.col("e"), F.lit(100.0)), kwh=F.col("recoverable_kwh"), customers=F.lit(1),
        reasons=F.slice(F.col("reasons"), 1, 3), x=F.col("x"), y=F.col("y"))


def geo_code(x: Column, y: Column, prefix: str = "SEC", metres: float = 100.0) -> Column:
    """Stable place code from the rounded coordinate: ``SEC-E620.1-N9755.4``."""
    km = lambda v: F.format_string("%.1f", F.bround(v / metres, 0) * metres / 1000.0)
    return F.when(x.isNull() | y.isNull(), F.lit(f"{prefix}-SIN-COORD")).otherwise(
        F.concat(F.lit(f"{prefix}-E"), km(x), F.lit("-N"), km(y)))


def sector_members(customers: DataFrame, cell: float = 300.0) -> DataFrame:
    """Customers with coordinates and the grid cell they fall in."""
    return customers.where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumns({
        "cell_x": F.floor(F.col("x") / cell), "cell_y": F.floor(F.col("y") / cell)})


def sectors(members: DataFrame, cell: float = 300.0) -> DataFrame:
    """Geographic sectors: centroid, radius, energy and scores per cell; members stay a table.

    The code is that of the cell's centre: it does not move with the members, and no two cells of 200 m or more share one.
    """
    key = ["cell_x", "cell_y"]
    g = members.groupBy(*key).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("recoverable_kwh").alias("kwh"), F.avg("score").alias("mean_score"),
        F.max("score").alias("max_score"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("feeder").alias("feeder"))
    d = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    radius = members.join(g.select(*key, "cx", "cy"), key).groupBy(*key).agg(F.max(d).alias("radius_m"))
    return g.join(radius, key).withColumn("sector", geo_code((F.col("cell_x") + 0.5) * cell, (F.col("cell_y") + 0.5) * cell))


def sector_targets(s: DataFrame) -> DataFrame:
    s = with_norm(stage(s, "targets"), e="kwh")
    return _target(
        s, "SECTOR", entity=F.col("sector"), feeder=F.col("feeder"), suspicion=F.col("mean_score"),
        priority=priority(F.col("mean_score"), F.col("e"), F.lit(100.0)), kwh=F.col("kwh"), customers=F.col("customers"),
        reasons=F.array(F.lit("Clientes sospechosos concentrados: recorrido eficiente para una cuadrilla")), x=F.col("cx"), y=F.col("cy"))


def organisation_targets(rolled: DataFrame) -> DataFrame:
    """Substations and units from the roll-up; each level is normalised on its own."""
    out = None
    for level, column in (("SUBESTACION", "substation"), ("UNIDAD_NEGOCIO", "unit")):
        r = with_norm(stage(rolled.where(F.col("level") == level), "targets"), e="ntl_kwh")
        share = F.coalesce("ntl_pct", F.lit(0.0)) / 100.0
        t = _target(
            r, level, entity=F.col(column), suspicion=share, priority=W_ENERGY * F.col("e") + W_SUSPICION * F.least(share * 5, F.lit(1.0)),
            kwh=F.col("ntl_kwh"), customers=_or(r, "customers", F.lit(0)),
            confidence=F.when(F.col("feeders_not_measured") > 0, 50.0).otherwise(100.0),
            reasons=_compact(F.when(F.col("feeders_not_measured") > 0, F.lit("El consolidado NO es verificable hasta instalar cabecera"))))
        out = t if out is None else out.unionByName(t)
    return out


def degrade_transferred(targets: DataFrame, affected: DataFrame) -> DataFrame:
    """Flag targets in feeders with a detected transfer as a data problem, with the reason first."""
    hit = affected.select("feeder").distinct().withColumn("__t", F.lit(True))
    note = F.lit("Transferencia de carga no reportada en este alimentador")
    return targets.join(hit, "feeder", "left").withColumns({
        "data_problem": F.col("data_problem") | F.coalesce("__t", F.lit(False)),
        "reasons": F.when(F.col("__t"), F.slice(F.concat(F.array(note), F.col("reasons")), 1, 3)).otherwise(F.col("reasons")),
    }).select(*COLUMNS)


def plan(*levels: DataFrame) -> DataFrame:
    out = levels[0]
    for t in levels[1:]:
        out = out.unionByName(t)
    return out


def plan_summary(targets: DataFrame) -> DataFrame:
    return targets.groupBy("level").agg(
        F.count(F.lit(1)).alias("targets"), F.count_if("data_problem").alias("data_problems"), F.sum("kwh").alias("kwh"))


def most_suspect(ranking: DataFrame, share: float = 0.30) -> DataFrame:
    """The best-ranked ``share`` of the customers, among whom sectors are looked for."""
    cut = ranking.agg((F.count(F.lit(1)) * share).alias("__cut"))
    return ranking.crossJoin(F.broadcast(cut)).where(F.col("rank") <= F.col("__cut")).drop("__cut")


def covered_customers(targets: DataFrame, members: DataFrame) -> DataFrame:
    """Customer targets inside a target that comes before them: by energy, then suspicion; on a tie the wider one is first.

    ``members``: level, entity, account, one row per customer that a target of another level covers.
    """
    rank = lambda p: F.struct(F.col(f"{p}kwh"), F.col(f"{p}suspicion"))
    wide = targets.where(F.col("level") != "CLIENTE").select("level", "entity", F.col("kwh").alias("w_kwh"), F.col("suspicion").alias("w_suspicion"))
    inside = members.join(wide, ["level", "entity"]).select(F.col("account").cast("string").alias("entity"), "w_kwh", "w_suspicion")
    # One row a customer: the best target that covers it.
    best = inside.groupBy("entity").agg(F.max(F.struct("w_kwh", "w_suspicion")).alias("__best"))
    customers = targets.where(F.col("level") == "CLIENTE").select("entity", "kwh", "suspicion")
    return customers.join(best, "entity").where(F.col("__best") >= rank("")).select("entity", F.lit("CLIENTE").alias("level"))


def work_orders(targets: DataFrame, members: DataFrame, top: int = 50, levels: Sequence[str] = (
        "PUESTO_TRANSFORMACION", "RUTA_COMERCIAL", "SECTOR", "CLIENTE")) -> DataFrame:
    """Best ``top`` orders by energy per visit, over the levels that a crew can be sent to; customers that a target
    before them covers are dropped, and so are targets with a data problem.

    ``members``: level, entity, account; or account, sector.
    """
    if "sector" in members.columns:
        members = members.select(F.lit("SECTOR").alias("level"), F.col("sector").alias("entity"), "account")
    ok = targets.where(F.col("level").isin(*levels) & ~F.col("data_problem"))
    best = ok.join(covered_customers(ok, members), ["level", "entity"], "left_anti").orderBy(
        F.col("kwh").desc(), F.col("suspicion").desc(), "level", "entity").limit(top)
    # At most ``top`` rows are numbered.
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("kwh").desc(), F.col("suspicion").desc(), "level", "entity"))
    return best.withColumn("work_order", F.format_string("OT-%04d", pos))


def location_log(targets: DataFrame, day: Column) -> DataFrame:
    """Targets with coordinates as dated rows of the location registry."""
    code = F.when(F.col("level") == "SECTOR", geo_code(F.col("x"), F.col("y"), "SEC"))
    for level, prefix in (("PUESTO_TRANSFORMACION", "PTR"), ("RAMAL", "RAM"), ("CLIENTE", "CLI")):
        code = code.when(F.col("level") == level, geo_code(F.col("x"), F.col("y"), prefix))
    code = code.otherwise(geo_code(F.col("x"), F.col("y"), "UBI"))
    return targets.where(F.col("x").isNotNull()).select(
        code.alias("location"), "level", "x", "y", "priority", "entity", day.alias("day"))


def locations(log: DataFrame, inspected: DataFrame | None = None) -> DataFrame:
    """Registry by place: first and last day, times prioritised (once per day), maxima, recurrence."""
    last = F.struct("day", "priority", "entity")
    g = log.groupBy("location").agg(
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.count_distinct("day").alias("times"),
        F.max("priority").alias("priority_max"), F.max_by("priority", last).alias("priority_last"),
        F.max_by("x", last).alias("x"), F.max_by("y", last).alias("y"), F.count_distinct("entity").alias("entities"))
    if inspected is None:
        return g.withColumn("inspected", F.lit(False)).withColumn("recurrent", F.col("times") >= 3)
    seen = inspected.select("location").distinct().withColumn("__i", F.lit(True))
    return g.join(seen, "location", "left").withColumn("inspected", F.coalesce("__i", F.lit(False))).drop("__i").withColumn(
        "recurrent", (F.col("times") >= 3) & ~F.col("inspected"))
