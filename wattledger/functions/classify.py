"""Customer class, voltage level and consumption stratum from free text and size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.params import Segmentation

# Class patterns, evaluated in this order.
CLASS_PATTERNS: list[tuple[str, str]] = [
    ("ALUMBRADO_PUBLICO", r"ALUMBRADO|A\.?\s*P\.?\b|LUMINARIA|SEMAFORO|SEM[ÁA]FORO"),
    ("BOMBEO_AGUA", r"BOMBEO|AGUA\s+POTABLE"),
    ("ASISTENCIA_SOCIAL", r"ASISTENCIA\s+SOCIAL|BENEFICIO\s+P[ÚU]BLICO|CULTO|IGLESIA|ESCENARIO[S]?\s+DEPORTIVO"),
    ("OFICIAL", r"OFICIAL|ENTIDAD(ES)?\s+P[ÚU]BLICA|GUBERNAMENTAL|MUNICIP"),
    ("INDUSTRIAL", r"INDUSTRIAL|ARTESANAL|MANUFACTUR"),
    ("COMERCIAL", r"COMERCIAL|GENERAL|NEGOCIO"),
    ("RESIDENCIAL", r"RESIDENCIAL|DOMICILIAR|DIGNIDAD|VIVIENDA|DOM[ÉE]STIC"),
]

# Voltage patterns, highest level first.
VOLTAGE_PATTERNS: list[tuple[str, str]] = [
    ("AT", r"ALTA\s+TENSI[ÓO]N|\bAT\b|ALTO\s+VOLTAJE"),
    ("MT", r"MEDIA\s+TENSI[ÓO]N|\bMT\b|MEDIO\s+VOLTAJE"),
    ("BT", r"BAJA\s+TENSI[ÓO]N|\bBT\b|BAJO\s+VOLTAJE"),
]

_FLAGS = "(?iu)"


def _ladder(text: Column, patterns: Sequence[tuple[str, str]], default: str) -> Column:
    out = None
    for label, pattern in patterns:
        hit = text.rlike(_FLAGS + pattern)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def consumption_class(tariff: Column) -> Column:
    """Ordered rules; text that matches none is never guessed to be residential."""
    return _ladder(F.trim(tariff), CLASS_PATTERNS, "NO_CLASIFICADO")


def voltage_level(tariff: Column) -> Column:
    return _ladder(tariff, VOLTAGE_PATTERNS, "DESCONOCIDO")


def billed_demand(tariff: Column) -> Column:
    """True/False when the tariff states with/without demand, NULL when it does not."""
    return F.when(tariff.rlike(_FLAGS + r"SIN\s+DEMANDA"), F.lit(False)).when(
        tariff.rlike(_FLAGS + r"CON\s+DEMANDA"), F.lit(True)
    )


def classify_distinct(df: DataFrame, tariff: str = "tariff") -> DataFrame:
    """Attach class, voltage level and demand flag to every row of ``df``."""
    t = F.col(tariff)
    return df.select(
        "*",
        consumption_class(t).alias("consumption_class"),
        voltage_level(t).alias("voltage_level"),
        billed_demand(t).alias("with_demand"),
    )


def catalogue_key(tariff: Column, keys: Sequence[str]) -> Column:
    """Catalogue key for a tariff text: exact, else class and voltage, else class, else the first.

    The keys are classified with the same rules as the text, on the Spark side,
    so both stay in step.
    """
    text = F.struct(tariff.alias("t"), consumption_class(tariff).alias("c"), voltage_level(tariff).alias("v"))
    catalogue = F.array(*[
        F.struct(F.lit(k).alias("k"), consumption_class(F.lit(k)).alias("c"), voltage_level(F.lit(k)).alias("v"))
        for k in keys
    ])

    def found(t: Column) -> Column:
        known = t["c"] != "NO_CLASIFICADO"
        exact = F.filter(catalogue, lambda e: e["k"] == t["t"])
        both = F.filter(catalogue, lambda e: known & (e["c"] == t["c"]) & (e["v"] == t["v"]))
        by_class = F.filter(catalogue, lambda e: known & (e["c"] == t["c"]))
        first = lambda a: F.get(a, F.lit(0))["k"]
        return F.coalesce(first(exact), first(both), first(by_class))

    # The text is classified once and bound to a variable; inside the filters it would be classified for every key.
    return F.get(F.transform(F.array(text), found), F.lit(0))


def stratum_label(kwh: Column, cuts: Sequence[float]) -> Column:
    """``E01_0-50`` … ``E08_1000+`` for the block ``kwh`` falls in."""
    out = F.when(kwh.isNull() | F.isnan(kwh), F.lit("E00_SIN_DATO"))
    low = 0.0
    for i, cut in enumerate(cuts, start=1):
        out = out.when(kwh <= cut, F.lit(f"E{i:02d}_{low:.0f}-{cut:.0f}"))
        low = cut
    return out.otherwise(F.lit(f"E{len(cuts) + 1:02d}_{low:.0f}+"))


def stratum(kwh: Column, cls: Column, p: Segmentation = Segmentation()) -> Column:
    return F.when(cls == "RESIDENCIAL", stratum_label(kwh, p.residential_cuts)).otherwise(
        stratum_label(kwh, p.other_cuts)
    )


def segment_columns(df: DataFrame, p: Segmentation = Segmentation()) -> DataFrame:
    """Stratum, composite segment, large-customer and peer-eligible flags.

    Needs ``consumption_class``, ``voltage_level`` and ``base_kwh``.
    """
    cls, volt, base = F.col("consumption_class"), F.col("voltage_level"), F.col("base_kwh")
    return (
        df.withColumn("stratum", stratum(base, cls, p))
        .withColumn("segment", F.concat_ws("|", cls, volt, F.col("stratum")))
        .withColumn("is_large", (F.coalesce(base, F.lit(0.0)) >= p.large_kwh) | volt.isin("MT", "AT"))
        .withColumn("peer_eligible", cls.isin("RESIDENCIAL", "COMERCIAL"))
    )
