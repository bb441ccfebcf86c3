"""Conductor description to material, area, voltage class and electrical values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Resistivity in ohm mm2/m at 20 C, and ampacity coefficient, by material.
RESISTIVITY = {"CU": 0.017774, "AL": 0.028264, "ACSR": 0.028264, "AAAC": 0.032600}
AMPACITY_K = {"CU": 15.9, "AL": 12.6, "ACSR": 12.6, "AAAC": 12.4}
AMPACITY_EXP = 0.72
STRANDING = 1.02
# Geometric mean distance in metres by voltage class.
GMD = {"BT": 0.30, "MT": 1.00, "AT": 3.00}
GMD_UNDERGROUND = 0.15
FREQUENCY = 60.0
MM2_PER_KCMIL = 0.5067074


def awg_area(gauge: Column) -> Column:
    """mm2 of an AWG size; ``4/0`` counts as -3. NULL outside -3..40."""
    aught = F.nullif(F.regexp_extract(gauge, r"^([1-4])/0$", 1), F.lit("")).cast("int")
    zeros = F.when(gauge.rlike(r"^0+$") & (F.length(gauge) <= 4), F.lit(1) - F.length(gauge))
    plain = F.when(gauge.rlike(r"^\d+$"), gauge.cast("int"))
    n = F.coalesce(F.lit(1) - aught, zeros, plain)
    diameter = F.lit(0.127) * F.pow(F.lit(92.0), (F.lit(36) - n) / F.lit(39.0))
    return F.when(n.between(-3, 40), F.lit(math.pi) * F.pow(diameter / 2.0, F.lit(2.0)))


def conductor_columns(df: DataFrame, description: str = "description") -> DataFrame:
    """Add material, area_mm2, gauge, voltage_class, underground and R, X, ampacity.

    A text without a readable gauge keeps NULL area and values; it is for the
    quality report, not for a guess. Each step refers to columns of the one
    before, so a capture is evaluated once.
    """
    text = F.upper(F.replace(F.col(description), F.lit(","), F.lit(".")))

    def grab(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract("__up", pattern, group), F.lit(""))

    up = F.col("__up")
    captured = df.withColumn("__up", text).withColumns({
        "material": F.when(up.contains("ACSR"), "ACSR")
        .when(up.rlike("AAAC|6201|ALEACI[OÓ]N"), "AAAC")
        .when(up.rlike(r"\bCU\b|COBRE"), "CU")
        .otherwise("AL"),
        "underground": up.rlike("TTU|SUBTERR|XLPE|CLASE"),
        "__insulated": up.rlike("TW|THHN|TTU|CONC[EÉ]NTRIC|MULTIPLEX|MULTICONDUCTOR|PREENSAMBLAD"),
        "__metric": up.rlike(r"MM\s*2|MM²|\bMM\b"),
        "__kv": grab(r"(\d+(?:\.\d+)?)\s*KV").cast("double"),
        "__kcmil": grab(r"(\d+(?:\.\d+)?)\s*(?:MCM|KCMIL)"),
        "__awg": grab(r"#?\s*(\d{1,2}/0|\d{1,4})\s*AWG"),
        "__nx": grab(r"(\d+)\s*X\s*(\d+(?:/0)?)"),
        "__sx": grab(r"(\d+)\s*X\s*(\d+(?:/0)?)", 2),
        "__mm2": grab(r"(\d+(?:\.\d+)?)\s*MM2"),
    })
    kv, awg, sx = F.col("__kv"), F.col("__awg"), F.col("__sx")
    areas = captured.withColumns({
        "voltage_class": F.when(kv >= 46, "AT").when(kv >= 1, "MT").when(F.col("__insulated"), "BT").otherwise("MT"),
        "__a1": F.col("__kcmil").cast("double") * MM2_PER_KCMIL,
        "__a2": awg_area(awg),
        "__a3": F.when(awg.try_cast("double") > 40, awg.try_cast("double") * MM2_PER_KCMIL),
        "__a4": F.when(F.col("__metric"), sx.try_cast("double")),
        "__a5": F.when(~F.col("__metric"), awg_area(sx)),
        "__a6": F.col("__mm2").cast("double"),
    })
    strand = F.concat(F.col("__nx"), F.lit("x"), sx)
    labels = [
        F.concat("__kcmil", F.lit(" kcmil")), F.concat(awg, F.lit(" AWG")),
        F.concat(awg, F.lit(" kcmil (etiquetado AWG)")), F.concat(strand, F.lit(" mm2")),
        F.concat(strand, F.lit(" AWG")), F.concat("__mm2", F.lit(" mm2")),
    ]
    first = F.coalesce(*[F.col(f"__a{i}") for i in range(1, 7)])
    gauge = F.coalesce(*[F.when(F.col(f"__a{i}").isNotNull(), label) for i, label in enumerate(labels, 1)])
    parsed = areas.withColumns({
        "area_mm2": F.when(first > 0, first), "gauge": F.when(first > 0, gauge),
    }).drop(*[c for c in areas.columns if c.startswith("__")])

    def lookup(values: dict[str, float], key: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv_ in values.items() for x in kv_]), key)

    area, under = F.col("area_mm2"), F.col("underground")
    gmr = F.lit(0.7788) * F.sqrt(area / F.lit(math.pi)) / F.lit(1000.0)
    gmd = F.when(under, F.lit(GMD_UNDERGROUND)).otherwise(lookup(GMD, F.col("voltage_class")))
    derate = F.when(under, F.lit(0.75)).otherwise(F.lit(1.0))
    return parsed.withColumns({
        "r_ohm_km": lookup(RESISTIVITY, F.col("material")) * 1000.0 / area * STRANDING,
        "x_ohm_km": F.when(gmd > gmr, F.lit(2 * math.pi * FREQUENCY * 2e-4) * F.log(gmd / gmr)).when(
            gmr.isNotNull(), F.lit(0.05)
        ),
        "ampacity_a": lookup(AMPACITY_K, F.col("material")) * F.pow(area, F.lit(AMPACITY_EXP)) * derate,
    })
