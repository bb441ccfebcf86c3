"""Column expressions that read the commercial and network text formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _to_double(text: Column) -> Column:
    return F.when(text.rlike(_PLAIN), text.try_cast("double"))


def locale_number(raw: Column, thousands: str = ".", decimal: str = ",") -> Column:
    """``1.302`` is 1302: ``.`` separates thousands and ``,`` decimals; blanks are NULL."""
    text = F.trim(raw.cast("string"))
    clean = text
    if thousands:
        clean = F.replace(clean, F.lit(thousands), F.lit(""))
    if decimal and decimal != ".":
        clean = F.replace(clean, F.lit(decimal), F.lit("."))
    blank = F.lower(text).isin("", "nan", "none", "null")
    return F.when(~blank, _to_double(clean))


def coordinate(raw: Column, decimal: str = ".") -> Column:
    """Metres with ``.`` as the decimal mark."""
    text = F.trim(raw.cast("string"))
    if decimal != ".":
        text = F.replace(text, F.lit(decimal), F.lit("."))
    return _to_double(text)


def phase_letters(mask: Column) -> Column:
    """Phase bitmask (A=4, B=2, C=1) as letters in the order A, B, C."""
    m = mask.cast("int")
    bit = lambda b, letter: F.when(m.bitwiseAND(F.lit(b)) > 0, F.lit(letter)).otherwise(F.lit(""))
    return F.coalesce(F.concat(bit(4, "A"), bit(2, "B"), bit(1, "C")), F.lit(""))


def phase_count(mask: Column) -> Column:
    return F.length(phase_letters(mask))


def nearest_value(x: Column, domain: Sequence[float]) -> Column:
    """Closest member of a fixed domain; the earlier member wins a tie."""
    options = F.array(*[
        F.struct(F.abs(F.lit(float(d)) - x).alias("d"), F.lit(i).alias("i"), F.lit(float(d)).alias("v"))
        for i, d in enumerate(domain)
    ])
    return F.when(x.isNotNull(), F.array_min(options)["v"])


def transformer_kva(raw: Column, domain: Sequence[float] | None = None) -> Column:
    """``15KVA`` or ``37,5`` to a number, optionally snapped to the valid sizes."""
    text = F.upper(raw.cast("string"))
    for unit in ("KVA", "KV"):
        text = F.replace(text, F.lit(unit), F.lit(""))
    text = F.replace(F.trim(text), F.lit(","), F.lit("."))
    kva = F.nullif(F.regexp_extract(text, r"(\d+\.?\d*)", 1), F.lit("")).cast("double")
    return nearest_value(kva, domain) if domain else kva


def length_with_origin(field_len: Column, system_len: Column, shape_len: Column, tol_pct: float = 30.0) -> Column:
    """Length and its provenance: field, else system, both only within tolerance, else shape."""
    def fits(v: Column) -> Column:
        return F.coalesce(
            (v > 0) & (shape_len > 0) & (F.abs(v - shape_len) / shape_len <= tol_pct / 100.0), F.lit(False)
        )

    def pick(v: Column, origin: str) -> Column:
        return F.struct(v.cast("double").alias("length"), F.lit(origin).alias("origin"))

    return (
        F.when(fits(field_len), pick(field_len, "MEDIDO"))
        .when(fits(system_len), pick(system_len, "CATALOGO"))
        .otherwise(pick(shape_len, "INFERIDO_TOPOLOGIA"))
    )


# Structure category by the first three letters of its code.
STRUCTURE_PREFIXES: dict[str, tuple[str, ...]] = {
    "ALUMBRADO": ("APO", "AOD", "AOC"),
    "SEMAFORO_CAMARA": ("CSP",),
    "TRANSFORMADOR": ("TRT", "TRR", "TRV", "TRS", "TUT", "TUV", "TUS"),
    "CONDUCTOR": ("COO",),
    "CAPACITOR": ("ECT", "ECR"),
    "REGULADOR": ("ECS", "ECV"),
    "MEDIDOR": ("MED", "MEC", "MET", "MEV", "MEU"),
    "POSTE": ("POO", "TOO"),
    "SECCIONADOR": ("SPT", "SPV", "SPR", "SPS", "SPO", "SPD", "SPE", "SST", "SSV", "SSS", "SSD"),
    "ESTRUCTURA": ("EST", "ESV", "ESR", "ESS", "ESD", "ESN", "ESE", "ESC", "EU0"),
}


def structure_category(code: Column) -> Column:
    prefix = F.upper(F.substring(code, 1, 3))
    ladder = F.when(prefix.startswith("SD"), F.lit("GENERACION"))
    for category, prefixes in STRUCTURE_PREFIXES.items():
        ladder = ladder.when(prefix.isin(*prefixes), F.lit(category))
    return ladder.otherwise(F.lit("OTRO"))


def unit_capacities(raw: Column) -> Column:
    """Unit kVA list from a JSON array, or from a single text like ``15KVA``."""
    as_list = F.from_json(raw, "array<double>")
    single = transformer_kva(raw)
    return F.when(F.trim(raw).startswith("["), as_list).when(single.isNotNull(), F.array(single)).otherwise(
        F.array().cast("array<double>")
    )
