"""Energy balance per feeder, its controls, and the roll-up through the organisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.operators.series import first_per_account
from wattledger.params import Balance

# The worse label has the higher number.
PRECEDENCE = {"MEDIDO": 0, "INDICATIVO": 1, "PARCIAL": 2, "SIN_DATOS": 3}

SUMMABLE = [
    "input_kwh", "billed_kwh", "lighting_kwh", "own_use_kwh", "loss_total_kwh", "technical_kwh", "ntl_kwh",
    "ntl_p10_kwh", "ntl_p90_kwh", "customers",
]


def _or(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def feeder_balance(df: DataFrame, p: Balance = Balance(), *, loss_rate: float = 0.0) -> DataFrame:
    """Balance per feeder; INDICATIVO when the head energy is missing.

    Needs ``billed_kwh`` and ``technical_kwh``; takes ``input_kwh``, ``lighting_kwh``,
    ``own_use_kwh``, ``not_supplied_kwh``, ``transferred_kwh`` when present.
    """
    zero = F.lit(0.0)
    billed = F.col("billed_kwh")
    filled = df.withColumns({
        "lighting_kwh": _or(df, "lighting_kwh", zero),
        "own_use_kwh": _or(df, "own_use_kwh", billed * (p.own_use_pct / 100.0)),
        "not_supplied_kwh": _or(df, "not_supplied_kwh", zero),
        "transferred_kwh": _or(df, "transferred_kwh", zero),
        "__in": F.col("input_kwh") if "input_kwh" in df.columns else F.lit(None).cast("double"),
    })
    estimate = (billed + F.col("lighting_kwh") + F.col("own_use_kwh")) / max(1e-9, 1.0 - loss_rate)
    measured = filled.withColumns({
        "balance_type": F.when(F.col("__in").isNull(), "INDICATIVO").otherwise("MEDIDO"),
        "input_kwh": F.coalesce(F.col("__in"), estimate),
    }).drop("__in")
    total = (
        F.col("input_kwh") + F.col("transferred_kwh") - billed - F.col("lighting_kwh") - F.col("own_use_kwh")
        - F.col("not_supplied_kwh")
    )
    share = lambda c: F.when(F.col("input_kwh") > 0, F.col(c) / F.col("input_kwh") * 100.0).otherwise(zero)
    return (
        measured.withColumn("loss_total_kwh", total)
        .withColumn("ntl_kwh", F.col("loss_total_kwh") - F.col("technical_kwh"))
        .withColumns({
            "ntl_pct": share("ntl_kwh"), "loss_pct": share("loss_total_kwh"), "technical_pct": share("technical_kwh"),
        })
    )


def with_controls(balance: DataFrame, p: Balance = Balance()) -> DataFrame:
    """Add ``controls``: C01-C04 always, C05/C06 only when their inputs exist."""
    def control(code: str, triggered: Column, observed: Column, threshold: Column) -> Column:
        return F.struct(
            F.lit(code).alias("code"), triggered.alias("triggered"), observed.cast("double").alias("observed"),
            threshold.cast("double").alias("threshold"),
        )
    c = F.col
    items = [
        control("C01", c("ntl_kwh") < 0, c("ntl_kwh"), F.lit(0.0)),
        control("C02", c("ntl_pct") > p.c02_max_pct, c("ntl_pct"), F.lit(p.c02_max_pct)),
        control("C03", c("billed_kwh") > c("input_kwh"), c("billed_kwh"), c("input_kwh")),
        control("C04", c("technical_pct") > p.c04_max_pct, c("technical_pct"), F.lit(p.c04_max_pct)),
    ]
    if {"customers_traced", "customers_declared"} <= set(balance.columns):
        gap = F.abs(c("customers_traced") - c("customers_declared")) / F.nullif("customers_declared", F.lit(0)) * 100.0
        items.append(F.when(gap.isNotNull(), control("C05", gap > p.c05_pct, gap, F.lit(p.c05_pct))))
    if "energy_coverage_pct" in balance.columns:
        cov = c("energy_coverage_pct")
        items.append(F.when(cov.isNotNull(), control("C06", cov < p.c06_min_pct, cov, F.lit(p.c06_min_pct))))
    return balance.withColumn("controls", F.filter(F.array(*items), lambda x: x.isNotNull()))


def load_hierarchy(raw: DataFrame, order: Column) -> DataFrame:
    """Feeder, substation, unit: mandatory columns, blanks dropped, first row per feeder."""
    missing = [c for c in ("feeder", "substation", "unit") if c not in raw.columns]
    if missing:
        raise ValueError(f"hierarchy lacks columns {missing}")
    clean = raw.select(
        F.trim("feeder").alias("feeder"), F.trim("substation").alias("substation"), F.trim("unit").alias("unit"),
        order.alias("__o"),
    ).where(F.col("feeder").isNotNull() & ~F.lower("feeder").isin("", "nan"))
    return first_per_account(clean, [F.col("__o"), F.col("substation"), F.col("unit")], "feeder").drop("__o")


def inferred_hierarchy(feeders: DataFrame, separator: str = "-", default_unit: str = "SIN_UN") -> DataFrame:
    """Unit from the code prefix; the substation stays unknown."""
    code = F.col("feeder")
    return feeders.select("feeder").distinct().select(
        "feeder",
        F.lit("SIN_SUBESTACION").alias("substation"),
        F.when(code.contains(separator), F.substring_index(code, separator, 1)).otherwise(F.lit(default_unit)).alias("unit"),
    )


def worst_type(column: str) -> Column:
    """Aggregate: the label with the highest precedence, unknown labels worst."""
    ladder = F.lit(9)
    for label, rank in PRECEDENCE.items():
        ladder = F.when(F.col(column) == label, F.lit(rank)).otherwise(ladder)
    return F.max_by(F.col(column), F.struct(ladder, F.col(column)))


def _rollup_columns(df: DataFrame) -> list[Column]:
    sums = [F.sum(c).alias(c) for c in SUMMABLE if c in df.columns]
    return [
        *sums,
        F.count_distinct("feeder").alias("feeders"),
        worst_type("balance_type").alias("balance_type"),
        F.count_distinct(F.when(F.col("balance_type") != "MEDIDO", F.col("feeder"))).alias("feeders_not_measured"),
    ]


def roll_up(balance: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Substation and unit totals in one pass (grouping sets); ``level`` tells which.

    Energies are summed, percentages recomputed on the totals, the worst balance
    type of the children wins, unmapped feeders go under SIN_*.
    """
    base = balance.drop("substation", "unit").join(hierarchy.select("feeder", "substation", "unit"), "feeder", "left")
    base = base.withColumns({
        "substation": F.coalesce("substation", F.lit("SIN_SUBESTACION")), "unit": F.coalesce("unit", F.lit("SIN_UN")),
    })
    grouped = base.groupingSets(
        [[F.col("unit"), F.col("substation")], [F.col("unit")]], F.col("unit"), F.col("substation")
    ).agg(F.grouping_id().alias("__g"), *_rollup_columns(base))
    pct = lambda c: F.round(F.col(c) / F.when(F.col("input_kwh") > 0, F.col("input_kwh")) * 100, 2)
    return grouped.select(
        F.when(F.col("__g") == 0, "SUBESTACION").otherwise("UNIDAD_NEGOCIO").alias("level"),
        "unit", "substation", *[c for c in grouped.columns if c not in ("unit", "substation", "__g")],
        pct("ntl_kwh").alias("ntl_pct"), pct("loss_total_kwh").alias("loss_pct"),
    )
