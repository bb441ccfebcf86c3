"""Technical losses, transformer loading, lighting, and the Monte-Carlo bands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.functions import electric as E
from wattledger.params import LOADING, TARIFF_CLASSES, Lighting, Losses


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() if kv[0] != "_default" for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def segment_peak_loss_kw(current: Column, r_km: Column, km: Column, phases: Column, neutral: Column | None = None,
                         r_neutral: Column | None = None) -> Column:
    watts = phases * current * current * r_km * km
    if neutral is not None and r_neutral is not None:
        watts = watts + F.when((neutral > 0) & (r_neutral > 0), neutral * neutral * r_neutral * km).otherwise(0.0)
    return watts / 1000.0


def bank_capacity(kvas: str, config: str) -> Column:
    """Three-phase capacity of a transformer bank from its unit sizes."""
    total = f"aggregate({kvas}, 0D, (a, x) -> a + x)"
    return F.expr(
        f"case {config} when 'BANCO_3' then 3D * {total} / nullif(size({kvas}), 0) "
        f"when 'DELTA_ABIERTO' then {math.sqrt(3.0)!r}D * array_min({kvas}) "
        f"when 'BANCO_DESIGUAL' then array_min({kvas}) * size({kvas}) "
        f"when 'DELTA_4H' then {total} - 0.05D * array_max({kvas}) else get({kvas}, 0) end")


def infer_bank(kvas: str) -> tuple[Column, Column]:
    """Configuration and confidence from the number and sizes of the units."""
    n = F.size(kvas)
    even = (F.array_max(kvas) - F.array_min(kvas)) / F.nullif(F.array_max(kvas), F.lit(0.0)) < 0.05
    config = F.when(n == 1, "UNIDAD_SIMPLE").when(n == 2, "DELTA_ABIERTO").when((n == 3) & even, "BANCO_3").when(
        n == 3, "DELTA_4H").otherwise("BANCO_DESIGUAL")
    trust = F.when(n == 1, 1.0).when(n == 2, 0.7).when((n == 3) & even, 0.9).when(n == 3, 0.6).otherwise(0.5)
    return config, trust


def bank_from_description(text: Column) -> Column:
    d = F.lower(text)
    return F.when(d.rlike("banco de 3|3 transformadores"), "BANCO_3").when(
        d.rlike("banco de 2|2 transformadores"), "DELTA_ABIERTO").otherwise("UNIDAD_SIMPLE")


def transformer_loss_kwh(p0: Column, pk: Column, s_max: Column, s_nom: Column, hours: float, factor: Column,
                         imbalance: float = 1.02) -> tuple[Column, Column]:
    """Total and no-load loss; the no-load part is not scaled by the loss factor."""
    idle = p0 * hours
    load = pk * (s_max / s_nom) * (s_max / s_nom) * hours * factor * imbalance
    return idle + load, idle


def meter_loss_kwh(meters: DataFrame, by: str, hours: float, p: Losses = Losses()) -> DataFrame:
    watts = lookup(p.meter_watts, F.col("meter_type"), p.meter_watts["_default"])
    return meters.groupBy(by).agg((F.sum(watts) * hours / 1000.0).alias("meter_kwh"))


def luminaire_energy(df: DataFrame, p: Lighting = Lighting()) -> DataFrame:
    """Monthly energy per lamp, hours clamped to the regulated range (flagged when clamped)."""
    hours = F.coalesce("hours", F.lit(0.0))
    days = F.coalesce(F.nullif("days", F.lit(0.0)), F.lit(p.days))
    aux = lookup(p.aux_watts, F.col("technology"), p.aux_watts["_default"])
    clamped = F.least(F.greatest(hours, F.lit(p.hours_min)), F.lit(p.hours_max))
    return df.withColumns({
        "energy_kwh": (F.coalesce("lamp_w", F.lit(0.0)) + aux) * clamped * days / 1000.0,
        "hours_clamped": ~hours.between(p.hours_min, p.hours_max),
        "metered": F.coalesce("metered", F.lit(False)),
    })


def lighting_summary(lamps: DataFrame) -> DataFrame:
    """Metered and unmetered energy by technology."""
    return lamps.groupBy("technology").agg(
        F.sum(F.when(F.col("metered"), F.col("energy_kwh")).otherwise(0.0)).alias("metered_kwh"),
        F.sum(F.when(~F.col("metered"), F.col("energy_kwh")).otherwise(0.0)).alias("unmetered_kwh"),
        F.count_if("hours_clamped").alias("clamped"))


def loading_class(ratio: Column) -> Column:
    """Only the first threshold is strict."""
    return (
        F.when(ratio > LOADING["critical"], "SOBRECARGADO_CRITICO").when(ratio >= LOADING["overloaded"], "SOBRECARGADO")
        .when(ratio >= LOADING["high"], "ALTA_CARGA").when(ratio >= LOADING["adequate"], "ADECUADO")
        .when(ratio >= LOADING["underused"], "SUBUTILIZADO").otherwise("MUY_SUBUTILIZADO")
    )


def phase_imbalance_pct(a: Column, b: Column, c: Column) -> Column:
    mean = (a + b + c) / 3.0
    return F.when(mean > 0, F.greatest(F.abs(a - mean), F.abs(b - mean), F.abs(c - mean)) / mean * 100.0).otherwise(0.0)


def rebalance_benefit_kwh(a: Column, b: Column, c: Column, r_neutral: Column, hours: float, factor: Column) -> Column:
    i = F.abs(a + b + c - 3 * F.least(a, b, c))
    return i * i * r_neutral * hours * factor / 1000.0


def transformer_table(zones: DataFrame, hours: float = 720.0, factor: float | None = None, p: Losses = Losses()) -> DataFrame:
    """Energy, peak, losses, loading and class per transformer site.

    Needs ``billed_kwh``, ``kva``, ``kvas``, ``config`` and ``spec`` (p0_kw, pk_kw).
    """
    c0 = next(iter(TARIFF_CLASSES.values()))
    fp = factor if factor is not None else p.k_default * c0["load_factor"] + (1 - p.k_default) * c0["load_factor"] ** 2
    s_max = E.velander_kw(F.col("billed_kwh"), F.lit(c0["a"]), F.lit(c0["b"])) / max(c0["cos_phi"], 0.1)
    sized = zones.withColumns({"s_max_kva": s_max, "capacity_kva": bank_capacity("kvas", "config")})
    total, idle = transformer_loss_kwh(
        F.col("spec.p0_kw"), F.col("spec.pk_kw"), F.col("s_max_kva"), F.col("kva"), hours, F.lit(fp), p.imbalance_factor)
    ratio = F.when(F.col("capacity_kva") > 0, F.col("s_max_kva") / F.col("capacity_kva")).otherwise(0.0)
    return sized.withColumns({"loss_kwh": total, "noload_kwh": idle, "loading_ratio": ratio}).withColumn(
        "loading_class", loading_class(F.col("loading_ratio")))


def _normal(keys: list[Column], factor: str, seed: int) -> Column:
    """Standard normal (Box-Muller) from counters: the same on any partitioning, and in any engine that has MD5."""
    def uniform(tag: str) -> Column:
        h = F.md5(F.concat_ws("|", *keys, F.lit(factor), F.lit(tag), F.lit(str(seed))).cast("binary"))
        return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))
    return F.sqrt(-2.0 * F.log(uniform("r"))) * F.cos(F.lit(2.0 * math.pi) * uniform("t"))


def _multiplier(keys: list[Column], factor: str, pct: float, seed: int) -> Column:
    return F.greatest(1.0 + pct / 100.0 * _normal(keys, factor, seed), F.lit(0.05))


def _bands(draws: DataFrame, by: list[str], value: str) -> DataFrame:
    """P10/P50/P90, mean and deviation; a group has as many rows as draws."""
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    g = draws.groupBy(*by).agg(q.alias("q"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("samples"))
    return g.select(*by, F.get("q", F.lit(0)).alias("p10"), F.get("q", F.lit(1)).alias("p50"), F.get("q", F.lit(2)).alias("p90"),
                    "mean", "std", "samples")


def montecarlo_losses(components: DataFrame, *, draws: int = 200, seed: int = 20260807, p0_pk: float = 15.0,
                      load_factor: float = 20.0, conductor: float = 10.0, length: float = 5.0) -> DataFrame:
    """Bands of the technical loss per feeder.

    ``components``: feeder, conductors_kwh, transformers_kwh, noload_kwh, meters_kwh.
    """
    d = components.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(max(1, draws)))))
    k = [F.col("feeder"), F.col("draw")]
    m = lambda name, pct: _multiplier(k, name, pct, seed)
    total = (
        F.col("conductors_kwh") * m("conductor", conductor) * m("length", length)
        + F.greatest(F.col("transformers_kwh") - F.col("noload_kwh"), F.lit(0.0)) * m("load_p", p0_pk) * m("load_f", load_factor)
        + F.col("noload_kwh") * m("noload_p", p0_pk) + F.col("meters_kwh"))
    return _bands(d.select("feeder", total.alias("v")), ["feeder"], "v")


def montecarlo_ntl(balance: DataFrame, losses: DataFrame, *, draws: int = 200, seed: int = 20260808) -> DataFrame:
    """Bands of the non-technical loss: total loss minus a clipped normal technical loss."""
    j = balance.select("feeder", "loss_total_kwh").join(losses.select("feeder", "mean", "std"), "feeder").withColumn(
        "draw", F.explode(F.sequence(F.lit(1), F.lit(max(1, draws)))))
    tech = F.greatest(
        F.col("mean") + F.greatest("std", F.lit(1e-9)) * _normal([F.col("feeder"), F.col("draw")], "ntl", seed), F.lit(0.0))
    return _bands(j.select("feeder", (F.col("loss_total_kwh") - tech).alias("v")), ["feeder"], "v")
