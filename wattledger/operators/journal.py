"""Change journal: intake, validation, domains, review, impact and history.

Columns of a change: package, owner, seq, layer, element, operation, field, before,
after, author, precision_m, synced, propagated_from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _truthy(c: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(c).cast("string"))).isin("1", "true", "t", "si", "sí"), F.lit(False))


def intake(journal: DataFrame) -> DataFrame:
    """New changes only; a missing author is the package owner's, and marked so."""
    return journal.where(~_truthy("synced")).withColumns({
        "author_filled": F.coalesce(F.trim("author") == "", F.lit(True)),
        "author": F.coalesce(F.nullif(F.trim("author"), F.lit("")), F.col("owner")),
    })


def intake_summary(journal: DataFrame) -> DataFrame:
    return journal.groupBy("package").agg(
        F.count_if(_truthy("synced")).alias("already_synced"), F.count_if(~_truthy("synced")).alias("new"),
        F.count_if(~_truthy("synced") & F.coalesce(F.trim("author") == "", F.lit(True))).alias("authors_filled"))


# Severity of each check.
CHECKS = {
    "SYNC02": "BLOQUEANTE", "SYNC03": "ADVERTENCIA", "SYNC10": "ADVERTENCIA", "SYNC11": "BLOQUEANTE", "SYNC12": "BLOQUEANTE",
    "SYNC13": "ADVERTENCIA", "SYNC14": "ADVERTENCIA", "SYNC15": "BLOQUEANTE", "SYNC16": "ADVERTENCIA", "SYNC17": "BLOQUEANTE",
    "SYNC18": "ADVERTENCIA", "SYNC19": "INFORMATIVO", "SYNC20": "BLOQUEANTE",
}


def validate_batches(
    packages: DataFrame, journal: DataFrame, *, photos: DataFrame | None = None, violations: DataFrame | None = None,
    network_version: str | None = None,
) -> DataFrame:
    """Findings per package: ``package, check, severity, count``.

    ``packages``: package, owner, uploaded_by, version. All journal checks are
    conditional counts of one aggregation, so a large package is combined on the
    map side.
    """
    new = intake(journal)
    op = F.col("operation")
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    seqs = F.max("seq") - F.min("seq") + 1 - F.count_distinct("seq")
    g = new.groupBy("package").agg(
        F.count(F.lit(1)).alias("changes"), seqs.alias("SYNC11"), F.count_if(blank("author")).alias("SYNC12"),
        F.count_if(F.col("author_filled") & ~blank("author")).alias("__filled"),
        F.count_if(op.isin("CREAR", "MOVER") & (F.col("precision_m") > 25)).alias("SYNC13"),
        F.count_if(blank("element")).alias("SYNC15"),
        F.count_if((op == "RECONECTAR") & (blank("before") | blank("after"))).alias("SYNC17"),
        F.count_if((op == "RECONECTAR") & F.col("before").eqNullSafe(F.col("after"))).alias("SYNC18"))
    old = journal.where(_truthy("synced")).groupBy("package").agg(F.count(F.lit(1)).alias("__old"))
    all_ = packages.join(g, "package", "left").join(old, "package", "left")
    if photos is not None:
        p = photos.groupBy("package").agg(
            F.count(F.lit(1)).alias("__photos"), F.count_if(blank("taken_at") | F.col("lat").isNull()).alias("SYNC14"))
        all_ = all_.join(p, "package", "left")
    else:
        all_ = all_.withColumns({"__photos": F.lit(0), "SYNC14": F.lit(0)})
    if violations is not None:
        all_ = all_.join(violations.groupBy("package").agg(F.count(F.lit(1)).alias("SYNC20")), "package", "left")
    else:
        all_ = all_.withColumn("SYNC20", F.lit(0))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    empty = (n("changes") == 0) & (n("__photos") == 0)
    one = lambda cond: F.when(F.coalesce(cond, F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    counts = {
        "SYNC02": one(F.col("owner") != F.col("uploaded_by")),
        "SYNC03": one((F.col("version") != "") & (F.col("version") != F.lit(network_version))) if network_version else F.lit(0).cast("bigint"),
        "SYNC10": one(empty & (n("__old") == 0)),
        "SYNC16": F.when(n("SYNC12") == 0, n("__filled")).otherwise(F.lit(0)).cast("bigint"),
        "SYNC19": F.when(empty, n("__old")).otherwise(F.lit(0)).cast("bigint"),
        **{c: n(c) for c in ("SYNC11", "SYNC12", "SYNC13", "SYNC14", "SYNC15", "SYNC17", "SYNC18", "SYNC20")},
    }
    long = all_.select("package", F.inline(F.array(*[
        F.struct(F.lit(c).alias("check"), F.lit(CHECKS[c]).alias("severity"), counts[c].alias("count")) for c in CHECKS])))
    return long.where(F.col("count") > 0)


def effective_domain(values: DataFrame, base: DataFrame, subtypes: DataFrame, rules: DataFrame) -> DataFrame:
    """Attach ``domain`` and ``mandatory`` to long attribute values; hidden fields are dropped.

    Precedence: contingency rule, then subtype, then base. ``values``: element,
    layer, subtype, field, value. ``base``: layer, field, domain, mandatory.
    ``subtypes``: layer, subtype, field, domain, mandatory, hidden. ``rules``: layer,
    field, when_field, when_value, domain, priority.
    """
    b = base.select("layer", "field", F.col("domain").alias("__b"), F.col("mandatory").alias("__bm"))
    s = subtypes.select("layer", "subtype", "field", F.col("domain").alias("__s"), F.col("mandatory").alias("__sm"), F.col("hidden").alias("__h"))
    r = rules.select("layer", "field", "when_field", "when_value", F.col("domain").alias("__rd"), "priority")
    state = values.select("element", "layer", F.col("field").alias("when_field"), F.col("value").alias("when_value"))
    hits = state.join(r, ["layer", "when_field", "when_value"]).groupBy("element", "layer", "field").agg(
        F.min_by("__rd", "priority").alias("__r"))
    return (
        values.join(b, ["layer", "field"], "left").join(s, ["layer", "subtype", "field"], "left").join(hits, ["element", "layer", "field"], "left")
        .where(~F.coalesce("__h", F.lit(False)))
        .select(*values.columns, F.coalesce("__r", "__s", "__b").alias("domain"),
                (F.coalesce("__sm", F.lit(False)) | F.coalesce("__bm", F.lit(False))).alias("mandatory"))
    )


def _admits(checked: DataFrame, codes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Add ``valid``: value in the coded list or range of its domain; blank or no domain is valid here."""
    listed = codes.select("domain", F.col("code").alias("value"), F.lit(True).alias("__in"))
    kinds = codes.select("domain").distinct().withColumn("__coded", F.lit(True))
    r = ranges.select("domain", "lo", "hi")
    number = F.col("value").try_cast("double")
    blank = F.coalesce(F.trim("value") == "", F.lit(True))
    ok = F.when(blank | F.col("domain").isNull(), F.lit(True)).when(F.col("__coded"), F.coalesce("__in", F.lit(False))).when(
        F.col("lo").isNotNull(), F.coalesce(number.between(F.col("lo"), F.col("hi")), F.lit(False))).otherwise(F.lit(True))
    return checked.join(listed, ["domain", "value"], "left").join(kinds, "domain", "left").join(r, "domain", "left").withColumn(
        "valid", ok).withColumn("blank", blank).drop("__in", "__coded", "lo", "hi")


def domain_violations(values: DataFrame, base: DataFrame, subtypes: DataFrame, rules: DataFrame, codes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Values outside their effective domain, and mandatory fields left blank."""
    c = _admits(effective_domain(values, base, subtypes, rules), codes, ranges)
    return c.where(~F.col("valid") | (F.col("mandatory") & F.col("blank"))).select(
        "element", "layer", "field", "value", "domain",
        F.when(F.col("valid"), "OBLIGATORIO").otherwise("FUERA_DE_DOMINIO").alias("problem"))


def change_subtype(values: DataFrame, new_subtype: DataFrame, base: DataFrame, subtypes: DataFrame, rules: DataFrame,
                   codes: DataFrame, ranges: DataFrame, defaults: DataFrame) -> DataFrame:
    """Bulk subtype change: every field with its new value and what happened to it.

    Valid values are kept, blanks take the default, invalid ones take the default
    or are cleared, hidden ones are dropped. ``new_subtype``: element, subtype.
    ``defaults``: layer, subtype, field, default.
    """
    moved = values.drop("subtype").join(new_subtype.select("element", "subtype"), "element")
    hidden = subtypes.where("hidden").select("layer", "subtype", "field", F.lit(True).alias("__hid"))
    shown = moved.join(hidden, ["layer", "subtype", "field"], "left").join(defaults, ["layer", "subtype", "field"], "left")
    blank = F.coalesce(F.trim("value") == "", F.lit(True))
    filled = shown.withColumn("__old", F.col("value")).withColumn(
        "value", F.when(blank & F.col("__hid").isNull(), F.col("default")).otherwise(F.col("value")))
    none = subtypes.withColumn("hidden", F.lit(False))
    c = _admits(effective_domain(filled, base, none, rules), codes, ranges)
    was_blank = F.coalesce(F.trim("__old") == "", F.lit(True))
    status = (
        F.when(F.col("__hid") & ~was_blank, "DESCARTADO").when(was_blank & F.col("value").isNotNull() & F.col("__hid").isNull(), "POR_DEFECTO")
        .when(F.col("__hid") | was_blank | F.col("valid"), "CONSERVADO").when(F.col("default").isNotNull(), "AJUSTADO").otherwise("INVALIDADO"))
    return c.withColumn("status", status).select(
        "element", "layer", "field", F.col("__old").alias("before"),
        F.when(F.col("status").isin("CONSERVADO", "POR_DEFECTO"), F.col("value")).when(F.col("status") == "AJUSTADO", F.col("default")).alias("after"),
        "status")


def review(changes: DataFrame, decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """Apply decisions and flag inconsistent propagation; blocked packages stay pending.

    A propagated change that was rejected while the element it comes from was accepted in its package is
    ``inconsistent``: the network would come apart there. Decisions are the reviewer's and are never rewritten.
    ``decisions``: package, seq, decision, reviewer.
    """
    blocked = findings.where(F.col("severity") == "BLOQUEANTE").select("package").distinct().withColumn("__b", F.lit(True))
    d = changes.join(decisions, ["package", "seq"], "left").join(blocked, "package", "left").withColumn(
        "state", F.when(F.col("__b"), "PENDIENTE").otherwise(F.coalesce("decision", F.lit("PENDIENTE")))).drop("__b", "decision")
    origins = d.select("package", F.col("seq").alias("propagated_from"), F.col("element").alias("__o"))
    accepted = d.where(F.col("state") == "ACEPTADO").select("package", F.col("element").alias("__o")).distinct()
    open_ = origins.join(accepted, ["package", "__o"], "left_semi").select("package", "propagated_from", F.lit(True).alias("__a")).distinct()
    return d.join(open_, ["package", "propagated_from"], "left").withColumn(
        "inconsistent", F.coalesce("__a", F.lit(False)) & (F.col("state") == "RECHAZADO")).drop("__a")


# Analysis stages that each operation makes stale.
STAGES = {
    "RECONECTAR": ["topologia", "flujo", "perdidas", "balance", "focalizacion", "ranking"],
    "CREAR": ["topologia", "flujo", "perdidas", "balance", "focalizacion"],
    "ELIMINAR": ["topologia", "flujo", "perdidas", "balance", "focalizacion"],
    "MOVER": ["perdidas", "flujo", "balance", "focalizacion"],
    "MODIFICAR": ["perdidas", "flujo", "balance"],
}


def affected_elements(accepted: DataFrame) -> DataFrame:
    """``(package, element)`` touched by accepted changes; a reconnection touches both sites."""
    ends = F.when(F.col("operation") == "RECONECTAR", F.array("element", "before", "after")).otherwise(F.array("element"))
    return accepted.select("package", F.explode(ends).alias("element")).where(
        F.col("element").isNotNull() & (F.col("element") != "")).distinct()


def impact(accepted: DataFrame, feeder_of: DataFrame) -> DataFrame:
    """Per package: elements, feeders and stages to recompute."""
    el = affected_elements(accepted).join(feeder_of.select("element", "feeder"), "element", "left").groupBy("package").agg(
        F.count_distinct("element").alias("elements"), F.count_distinct("feeder").alias("feeders"))
    stages = F.array().cast("array<string>")
    for op, names in STAGES.items():
        stages = F.when(F.col("operation") == op, F.array(*[F.lit(n) for n in names])).otherwise(stages)
    customer = F.when(F.col("layer") == "cliente", F.array(F.lit("ranking"), F.lit("focalizacion"))).otherwise(F.array().cast("array<string>"))
    # Stage names form a short fixed list, so the set per package is bounded.
    st = accepted.select("package", F.explode(F.concat(stages, customer)).alias("stage")).groupBy("package").agg(
        F.array_sort(F.collect_set("stage")).alias("stages"))
    n = accepted.groupBy("package").agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("operation") == "RECONECTAR").alias("reconnections"))
    return n.join(el, "package", "left").join(st, "package", "left")


def affected_feeders(accepted: DataFrame, feeder_of: DataFrame) -> DataFrame:
    return affected_elements(accepted).join(feeder_of.select("element", "feeder"), "element").select("package", "feeder").distinct()


def history_rows(changes: DataFrame, origin: str) -> DataFrame:
    return changes.withColumn("origin", F.lit(origin))


def element_history(history: DataFrame, element: str) -> DataFrame:
    return history.where(F.col("element") == element).orderBy("at", "seq")


def history_by_origin(history: DataFrame) -> DataFrame:
    return history.groupBy("origin").agg(
        F.count(F.lit(1)).alias("changes"), F.count_distinct("element").alias("elements"), F.count_distinct("author").alias("authors"))


def most_edited(history: DataFrame, top: int = 20) -> DataFrame:
    return history.groupBy("element").agg(
        F.count(F.lit(1)).alias("changes"), F.count_distinct("author").alias("authors"), F.max("at").alias("last"),
    ).orderBy(F.col("changes").desc(), "element").limit(top)
