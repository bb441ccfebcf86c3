"""Hand-computed values, injected truth and brute-force comparisons on small fixtures."""

import random
from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattledger import staging
from wattledger.functions import classify, electric, parse
from wattledger.operators import (
    entities, fieldwork, inspections, losses, network, outliers, powerflow, rangejoin, ranking, scenarios, series, signals,
    survey, tours, transfers, validation,
)
from wattledger.params import Averaging
from wattledger.sources import readers, sinks


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- distributed ranks and percentiles ----------------------------------------

def test_rank_and_percentiles_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    values = np.where(rng.random(3000) < 0.4, 0.0, rng.integers(0, 500, 3000) / 4)
    groups = np.where(rng.random(3000) < 0.5, "hot", rng.choice(list("abcdef"), 3000))
    df = spark.createDataFrame([(int(i), str(g), float(v)) for i, (g, v) in enumerate(zip(groups, values))], "id long, g string, v double")
    df = df.repartition(7)
    got = {r["g"]: (r["lo"], r["mid"], r["n"]) for r in ranking.exact_percentiles(df, ["g"], "v", {"lo": 0.05, "mid": 0.5}).collect()}
    for g in set(groups):
        mine = values[groups == g]
        assert got[g] == pytest.approx((np.percentile(mine, 5), np.median(mine), len(mine)))
    ranked = ranking.global_rank(df, [F.col("v").desc(), F.col("id")]).orderBy("rank").collect()
    want = sorted(range(3000), key=lambda i: (-values[i], i))
    assert [r["id"] for r in ranked] == want and [r["rank"] for r in ranked] == list(range(1, 3001))


def test_percentiles_without_rows(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert ranking.exact_percentiles(empty, ["g"], "v", {"m": 0.5}).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e4, 1e4), st.floats(0, 500)), min_size=1, max_size=25), st.lists(st.floats(-1e4, 1e4), min_size=1, max_size=40))
def test_interval_join_equals_brute_force(spark, intervals, points):
    p = spark.createDataFrame([("k", i, x) for i, x in enumerate(points)], "k string, p int, x double")
    v = spark.createDataFrame([("k", i, c - w, c + w) for i, (c, w) in enumerate(intervals)], "k string, i int, lo double, hi double")
    want = sorted((i, j) for i, (c, w) in enumerate(intervals) for j, x in enumerate(points) if c - w <= x <= c + w)
    assert rows(rangejoin.interval_join(p, v, ["k"], "x", "lo", "hi"), "i", "p") == want


# --- parsing and formulas -------------------------------------------------------

@pytest.mark.parametrize("text, value", [("1.302", 1302.0), ("963", 963.0), ("0", 0.0), ("", None), ("nan", None), ("12,5", 12.5), ("x1", None)])
def test_locale_number(spark, text, value):
    assert spark.range(1).select(parse.locale_number(F.lit(text)).alias("v")).first()["v"] == value


@pytest.mark.parametrize("text, cls, volt", [
    ("INDUSTRIAL CON DEMANDA MEDIA TENSION", "INDUSTRIAL", "MT"), ("Residencial Dignidad", "RESIDENCIAL", "DESCONOCIDO"),
    ("ALUMBRADO PUBLICO", "ALUMBRADO_PUBLICO", "DESCONOCIDO"), ("", "NO_CLASIFICADO", "DESCONOCIDO"), ("algo raro", "NO_CLASIFICADO", "DESCONOCIDO")])
def test_tariff_classes(spark, text, cls, volt):
    r = spark.range(1).select(classify.consumption_class(F.lit(text)).alias("c"), classify.voltage_level(F.lit(text)).alias("v")).first()
    assert (r["c"], r["v"]) == (cls, volt)


def test_month_axis_and_columns():
    assert series.month_axis(date(2026, 1, 1), 3) == [date(2025, 11, 1), date(2025, 12, 1), date(2026, 1, 1)]
    assert series.month_axis(date(2026, 1, 1), 2, oldest_first=False)[0] == date(2026, 1, 1)
    assert series.reading_columns(["KWH_10", "KWH_2", "X"]) == ["KWH_2", "KWH_10"]
    with pytest.raises(ValueError):
        series.reading_columns(["A"])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=20))
def test_power_properties(spark, energies):
    df = spark.createDataFrame([(e,) for e in energies], "e double")
    p = electric.velander_kw(F.col("e"), F.lit(0.0002), F.lit(0.03))
    q = electric.reactive_kvar(p, F.lit(0.92))
    fc = F.col("e") / 1e6
    out = df.select(p.alias("p"), electric.apparent_kva(p, q).alias("s"), fc.alias("fc"), electric.loss_factor(fc, F.lit(0.3)).alias("fp"))
    for r in out.collect():
        assert r["s"] >= r["p"] - 1e-9
        assert r["fc"] ** 2 - 1e-12 <= r["fp"] <= r["fc"] + 1e-12


def _series(spark, *arrays, **extra):
    return spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "account int, series array<double>")


@pytest.mark.parametrize("method, want", [("mean", 14.0), ("trimmed", 5.5), ("median", 5.5)])
def test_averages(spark, method, want):
    s = _series(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 95.0])
    assert series.representative_average(s, Averaging(method=method)).first()["avg_kwh"] == pytest.approx(want)


def test_average_edge_cases(spark):
    s = _series(spark, [None, None], [0.0, 0.0, 6.0]).withColumn("suspended", F.lit(True))
    a, b = series.representative_average(s).orderBy("account").collect()
    assert (a["avg_kwh"], a["n_valid"], a["cv"]) == (0.0, 0, None)
    assert (b["avg_kwh"], b["n_valid"], b["reliable"]) == (6.0, 1, False)


def test_own_history_signals(spark):
    flat, zeros = [100.0, 100.5] * 6, [100.0] * 8 + [0.0] * 4
    drop = [100.0] * 4 + [20.0] * 4 + [100.0] * 4
    broken = [100.0, 110.0, 90.0, 105.0, 95.0, 100.0, 40.0, 44.0, 36.0, 42.0, 38.0, 40.0]
    df = series.series_statistics(_series(spark, flat, zeros, drop, broken)).withColumn("active", F.lit(True))
    got = {r["account"]: r for r in signals.own_history_signals(df).collect()}
    assert got[0]["S7"] > 0.9 and got[0]["S1"] == 0
    assert got[1]["S4"] == pytest.approx(4 / 6)
    assert got[2]["S1"] == pytest.approx(min(1, 4 / 3 * 0.6))
    assert got[3]["S3"] == pytest.approx(0.6)


# --- transfers --------------------------------------------------------------------

def test_injected_transfer_is_found_and_a_spike_is_not(spark):
    rng = np.random.default_rng(5)
    base = {f: b for f, b in zip("ABCDEF", (300e3, 420e3, 380e3, 500e3, 450e3, 350e3))}
    data = []
    for f, b in base.items():
        for m in range(12):
            v = b * (1 + 0.005 * rng.standard_normal()) * (1 + 0.1 * np.sin(m / 2))
            if m >= 6:
                v += {"B": -75e3, "C": 75e3}.get(f, 0)
            if m == 3:
                v += {"D": -80e3, "E": 80e3}.get(f, 0)
            data.append((f, date(2024, m + 1, 1), float(v)))
    res = transfers.residuals(spark.createDataFrame(data, "feeder string, period date, kwh double"))
    found = rows(transfers.transfer_candidates(res), "feeder_a", "feeder_b", "period")
    assert found == [("B", "C", date(2024, 7, 1))]


def test_two_periods_are_not_enough(spark):
    h = spark.createDataFrame([("A", date(2024, m, 1), 1.0) for m in (1, 2)], "feeder string, period date, kwh double")
    assert transfers.residuals(h).count() == 0
    assert transfers.detection_status(h).first()["status"] == "NO_APLICABLE_POR_DATOS"


# --- network ------------------------------------------------------------------------

def _edges(spark, pairs):
    return spark.createDataFrame(
        [(f, f"s{i}", a, b, 0.5, "C0", 3, 13800.0) for i, (f, a, b) in enumerate(pairs)],
        "feeder string, segment_id string, from_node string, to_node string, length_km double, conductor string, n_phases int, voltage_v double")


def test_line_mesh_island_and_reversed_edges(spark):
    e = _edges(spark, [("L", "r", "a"), ("L", "a", "b"), ("L", "b", "c"),
                       ("M", "r", "a"), ("M", "r", "b"), ("M", "a", "b"), ("I", "r", "a"), ("I", "x", "y"), ("R", "a", "r"), ("R", "b", "a")])
    src = spark.createDataFrame([(f, "r") for f in "LMIR"], "feeder string, source string")
    t = network.orient(e, src)
    assert rows(t.where("feeder = 'L'"), "node", "depth") == [("a", 1), ("b", 2), ("c", 3), ("r", 0)]
    assert rows(t.where("feeder = 'R' and parent is not null"), "node", "parent") == [("a", "r"), ("b", "a")]
    assert rows(network.islands(e, t), "feeder", "node") == [("I", "x"), ("I", "y")]
    assert rows(network.cycle_test(e, t).where("has_cycle"), "feeder") == [("M",)]
    km = network.path_km(t, network.jump_levels(t))
    assert {(r["node"], r["path_km"]) for r in km.where("feeder = 'L'").collect()} == {("r", 0.0), ("a", 0.5), ("b", 1.0), ("c", 1.5)}


def test_transformers_in_series_do_not_count_twice(spark):
    e = _edges(spark, [("F", "r", "t1"), ("F", "t1", "c1"), ("F", "t1", "t2"), ("F", "t2", "c2")])
    t = network.orient(e, spark.createDataFrame([("F", "r")], "feeder string, source string"))
    sites = spark.createDataFrame([("F", "t1", "T1", 50.0), ("F", "t2", "T2", 25.0)], "feeder string, node string, site string, kva double")
    cust = spark.createDataFrame([("F", "c1", 100.0, True, False), ("F", "c1", 60.0, False, True), ("F", "c2", 30.0, False, False)],
                                 "feeder string, node string, energy_kwh double, totaliser boolean, under_totaliser boolean")
    lamp = spark.createDataFrame([("F", "c2", 5.0, False, False)], "feeder string, node string, energy_kwh double, metered boolean, traffic boolean")
    z = network.lv_zones(sites, cust, lamp, network.assign_to_sites(t, network.jump_levels(t), sites))
    assert rows(z, "site", "customers", "billed_kwh", "totaliser_residual_kwh", "lighting_kwh") == [("T1", 2, 100.0, 40.0, 0.0), ("T2", 1, 30.0, 0.0, 5.0)]


@pytest.mark.parametrize("block", [4, 1 << 15])
def test_nearest_ancestor_equals_walks_up_in_two_stages(spark, monkeypatch, block):
    """Chains and random trees over many ranges of places; a flagged node that comes twice gives its rows twice."""
    monkeypatch.setattr(tours, "BLOCK", block)
    monkeypatch.setattr(network, "BLOCK", block)
    rnd = random.Random(7)
    up = {("C", f"{i:03d}"): f"{i - 1:03d}" for i in range(1, 120)}
    up |= {("T", f"{i:03d}"): f"{rnd.randrange(max(0, i - 6), i):03d}" for i in range(1, 120)}
    t = network.orient(_edges(spark, [(f, p, n) for (f, n), p in up.items()]),
                       spark.createDataFrame([("C", "000"), ("T", "000")], "feeder string, source string"))
    flags = [("C", f"{i:03d}", f"c{i}") for i in (3, 40, 41, 90)] + [("T", f"{i:03d}", f"t{i}") for i in range(2, 120, 7)] + [("C", "040", "again"), ("C", "060", None)]
    labels = {}
    for f, n, x in flags:
        if x is not None:
            labels.setdefault((f, n), []).append(x)
    want = []
    for f in "CT":
        for i in range(120):
            n = f"{i:03d}"
            while n is not None and (f, n) not in labels:
                n = up.get((f, n))
            want += [(f, f"{i:03d}", x) for x in labels.get((f, n), [None])]
    before = len(staging._STAGES)
    got = network.nearest_ancestor(t, None, spark.createDataFrame(flags, "feeder string, node string, mark string"), "mark", "found")
    assert len(staging._STAGES) - before == 2
    key = lambda r: tuple(str(v) for v in r)
    assert sorted([tuple(r) for r in got.select("feeder", "node", "found").collect()], key=key) == sorted(want, key=key)


def test_hash_does_not_depend_on_row_order(spark):
    e = _edges(spark, [("F", "r", "a"), ("F", "a", "b")])
    s = spark.createDataFrame([("F", "a", "T", 1.0, "X", 3)], "feeder string, node string, site string, kva double, config string, phases int")
    w = spark.createDataFrame([("F", "a", "C", "C")], "feeder string, node string, normal_pos string, current_pos string")
    src = spark.createDataFrame([("F", "r")], "feeder string, source string")
    one = network.feeder_hashes(e, s, w, src).first()
    two = network.feeder_hashes(e.orderBy(F.desc("segment_id")).repartition(3), s, w, src).first()
    other = network.feeder_hashes(e.withColumn("length_km", F.col("length_km") + 1), s, w, src).first()
    assert one == two and one["topology"] != other["topology"] and one["attribute"] == other["attribute"]


def test_load_flow_matches_closed_form(spark):
    """One light load at the end of a line: losses are 3 I2 R."""
    e = _edges(spark, [("F", "r", "a"), ("F", "a", "b")])
    src = spark.createDataFrame([("F", "r")], "feeder string, source string")
    t = network.orient(e, src)
    cond = spark.createDataFrame([("C0", 0.5, 0.4)], "code string, r_ohm_km double, x_ohm_km double")
    z = powerflow.impedances(t, e, cond, t_op=20.0)
    base = powerflow.base_voltages(z, e, src)
    lv = network.jump_levels(t)
    load = spark.createDataFrame([("F", "b", 60.0, 1.0)], "feeder string, node string, kw double, pf double")
    r = powerflow.flow_summary(powerflow.balanced_flow(z, load, base, lv)).first()
    i = 20e3 / (13800 / 3 ** 0.5)
    assert r["converged"] and r["loss_kw_peak"] == pytest.approx(3 * i * i * 0.5 / 1000, rel=0.02) and r["v_min_pu"] < 1
    by_phase = spark.createDataFrame([("F", "b", 20.0, 20.0, 20.0)], "feeder string, node string, kw_a double, kw_b double, kw_c double")
    u = powerflow.unbalanced_summary(powerflow.unbalanced_flow(z, by_phase, base, lv, pf=1.0)).first()
    assert u["converged"] and u["loss_neutral_kw"] == pytest.approx(0, abs=1e-9) and u["imbalance_pct_max"] == pytest.approx(0, abs=1e-6)
    assert u["loss_phases_kw"] == pytest.approx(r["loss_kw_peak"], rel=0.02)
    one_phase = spark.createDataFrame([("F", "b", 60.0, 0.0, 0.0)], "feeder string, node string, kw_a double, kw_b double, kw_c double")
    v = powerflow.unbalanced_summary(powerflow.unbalanced_flow(z, one_phase, base, lv, pf=1.0)).first()
    assert v["loss_neutral_kw"] > 0 and v["imbalance_pct_max"] == pytest.approx(200, abs=1e-6)


def test_load_flow_converges_by_feeder(spark):
    """A feeder that cannot carry its load leaves the others converged, and frozen at their own sweep."""
    e = _edges(spark, [("F", "r", "a"), ("G", "r", "a"), ("H", "r", "a"), ("H", "a", "b")])
    src = spark.createDataFrame([("F", "r"), ("G", "r"), ("H", "r")], "feeder string, source string")
    t = network.orient(e, src)
    cond = spark.createDataFrame([("C0", 0.5, 0.4)], "code string, r_ohm_km double, x_ohm_km double")
    z, lv = powerflow.impedances(t, e, cond, t_op=20.0), network.jump_levels(t)
    base = powerflow.base_voltages(z, e, src)
    load = spark.createDataFrame([("F", "a", 60.0, 1.0), ("G", "a", 1e9, 0.9), ("H", "b", 5000.0, 0.9)], "feeder string, node string, kw double, pf double")
    three = load.select("feeder", "node", *[(F.col("kw") / 3).alias(f"kw_{c}") for c in "abc"])
    for rows in (powerflow.flow_summary(powerflow.balanced_flow(z, load, base, lv, max_sweeps=7)).collect(),
                 powerflow.unbalanced_summary(powerflow.unbalanced_flow(z, three, base, lv, max_sweeps=7)).collect()):
        got = {r["feeder"]: r for r in rows}
        assert sorted(got) == ["F", "G", "H"]
        assert got["F"]["converged"] and got["H"]["converged"] and not got["G"]["converged"]
        assert got["F"]["iterations"] <= got["H"]["iterations"] < 7


def test_sectors_of_neighbouring_cells_have_their_own_code(spark):
    """Centroids on either side of a cell border round to one place; the codes must differ."""
    pts = spark.createDataFrame([("1", 299.0, 10.0), ("2", 301.0, 10.0), ("3", 302.0, 10.0)], "account string, x double, y double").selectExpr(
        "*", "1.0D AS recoverable_kwh", "0.5D AS score", "'F' AS feeder")
    s = survey.sectors(survey.sector_members(pts)).collect()
    assert len(s) == 2 and len({r["sector"] for r in s}) == 2


def test_montecarlo_is_independent_of_partitioning(spark):
    c = spark.createDataFrame([(f"F{i}", 100.0, 80.0, 30.0, 5.0) for i in range(6)],
                              "feeder string, conductors_kwh double, transformers_kwh double, noload_kwh double, meters_kwh double")
    a, b = losses.montecarlo_losses(c.coalesce(1)), losses.montecarlo_losses(c.repartition(5))
    assert rows(a, "feeder", "p10", "p50") == rows(b, "feeder", "p10", "p50")
    r = a.first()
    assert r["p10"] < r["p50"] < r["p90"] and abs(r["mean"] - 185) < 10 and r["samples"] == 200


# --- peers, outliers, learning --------------------------------------------------------

def test_odd_entity_among_peers(spark):
    rng = np.random.default_rng(2)
    data = [(f"e{i:02d}", "u" if i < 30 else "v", float(rng.normal(100, 10)), float(rng.normal(50, 5)), 10.0 + float(rng.normal(0, 0.3))) for i in range(33)]
    data[7] = (*data[7][:4], 25.0)
    df = spark.createDataFrame(data, "id string, unit string, a double, b double, pct double")
    out = entities.compare_with_peers(df, entity="id", metric="pct", profile=["a", "b", "pct"], block=["unit"])
    assert rows(out, "id", "severity") == [("e07", "ALTA")]
    with pytest.raises(ValueError):
        entities.usable_profile(["pct"], ["pct"], "pct")


def test_nearest_peers_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = np.round(rng.normal(0, 1, (60, 3)), 3)
    df = spark.createDataFrame([(f"e{i:02d}", "*", True, *map(float, p)) for i, p in enumerate(pts)], "id string, blk string, asks boolean, z0 double, z1 double, z2 double")
    got = {}
    for r in entities.nearest_peers(df, ["z0", "z1", "z2"], 4, entity="id", block="blk").collect():
        got.setdefault(r["id"], {})[r["position"]] = r["peer"]
    for i in range(60):
        d = np.linalg.norm(pts - pts[i], axis=1)
        want = [f"e{j:02d}" for j in sorted((j for j in range(60) if j != i), key=lambda j: (d[j], j))[:4]]
        assert [got[f"e{i:02d}"][k] for k in (1, 2, 3, 4)] == want


def test_outlier_score(spark):
    data = [(i, float(i % 7) / 100, float(i % 5) / 100) for i in range(300)] + [(999, 1.0, 1.0)]
    df = spark.createDataFrame(data, "account int, S1 double, S2 double")
    s = outliers.outlier_scores(df, ["S1", "S2"]).orderBy(F.desc("unsupervised")).collect()
    assert s[0]["account"] == 999 and s[0]["unsupervised"] == 1.0 and all(0 <= r["unsupervised"] <= 1 for r in s)
    few = outliers.outlier_scores(df.limit(10), ["S1", "S2"])
    assert few.where("unsupervised is not null").count() == 0


def test_pu_learning_with_few_positives_is_zero(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "account int, f double")
    out = validation.pu_learning(df, df.where("account < 5"), ["f"])
    assert out.agg(F.max("pu_score")).first()[0] == 0.0


def test_pu_learning_separates_and_corrects(spark):
    """Half of the thieves are labelled: all thieves score alike and far above the others, the propensity is near a half."""
    rng = random.Random(2)
    rows = [(i, rng.uniform(0.6, 1.0) if i % 5 == 0 else rng.uniform(0.0, 0.45), rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "account int, a double, noise double")
    out = validation.pu_learning(df, df.where("account % 10 = 0"), ["a", "noise"]).collect()
    assert len(out) == 2000 and 0.4 < out[0].propensity < 0.6
    high = [r.pu_score for r in out if r.account % 5 == 0]
    low = [r.pu_score for r in out if r.account % 5]
    assert min(high) > 0.7 and max(low) < 0.2
    again = {r.account: r.pu_score for r in validation.pu_learning(df.repartition(7), df.where("account % 10 = 0"), ["a", "noise"]).collect()}
    assert all(again[r.account] == pytest.approx(r.pu_score, abs=1e-9) for r in out)


def test_registry_reload_changes_nothing(spark):
    f = spark.createDataFrame([("1", "true", "conexion_directa", "2024-01-05", "OT1", "t", "5"), ("2", "no", "SIN_NOVEDAD", "2024-01-05", "OT1", "t", "5"),
                               ("3", "1", "PREDIO_CERRADO", "2024-01-06", "OT1", "t", None)],
                              "account string, inspected string, finding string, inspected_on string, work_order string, technician string, meter_reading string")
    x = inspections.extract_inspections(f).withColumn("loaded_at", F.lit(1))
    once = inspections.upsert_registry(None, x)
    twice = inspections.upsert_registry(once, x)
    assert rows(once, "account", "verdict") == rows(twice, "account", "verdict") == [("1", "CONFIRMADO"), ("3", "NO_CONCLUYENTE")]
    assert inspections.verified_negatives(twice).count() == 0      # a closed house is not innocent
    assert inspections.campaign_summary(twice).first()["precision_pct"] == 100.0


def test_peers_over_several_axes_meet_few_candidates(spark):
    """A first axis of three values, ties, a repeated point, and a block of three; brute force and candidates an asker."""
    rng = np.random.default_rng(9)
    p = np.column_stack([rng.integers(0, 3, 2000), rng.normal(size=2000), rng.normal(size=2000)]).astype(float)
    p[100] = p[101] = p[102]
    rows = [(f"e{i:04d}", "big" if i >= 3 else "small", i % 2 == 0 or i < 3, *map(float, v)) for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "entity string, blk string, asks boolean, x double, y double, z double")
    got = {}
    for r in entities.nearest_peers(df, ["x", "y", "z"], 5, entity="entity", block="blk").collect():
        got.setdefault(r["entity"], {})[r["position"]] = r["peer"]
    for i in [0, 1, 2, *range(4, 2000, 2)]:
        inside = [j for j in (range(3) if i < 3 else range(3, 2000)) if j != i]
        d = np.sqrt(((p[inside, 0] - p[i, 0]) ** 2 + (p[inside, 1] - p[i, 1]) ** 2) + (p[inside, 2] - p[i, 2]) ** 2)
        want = [f"e{inside[j]:04d}" for j in np.lexsort((inside, d))[:5]]
        assert [got[f"e{i:04d}"][k] for k in sorted(got[f"e{i:04d}"])] == want
    met = entities.peer_candidates(df, ["x", "y", "z"], 5, entity="entity", block="blk").groupBy("e").count().agg({"count": "avg"}).first()[0]
    assert met < 40
    assert entities.nearest_peers(df.limit(0), ["x", "y", "z"], 5, entity="entity", block="blk").count() == 0


# --- field work, scope, scenarios, sources --------------------------------------------

def test_distribution_loses_no_order_and_is_balanced(spark):
    rng = np.random.default_rng(4)
    o = spark.createDataFrame([(i, "U", float(rng.integers(1, 50)), float(rng.random() * 1e4), float(rng.random() * 1e4)) for i in range(90)],
                              "work_order int, unit string, weight double, x double, y double")
    crews = spark.createDataFrame([("U", f"c{i}") for i in range(6)], "unit string, crew string")
    a = fieldwork.distribute(o, crews)
    assert a.count() == 90 and a.where("crew is null").count() == 0
    m = fieldwork.assignment_metrics(a)
    assert {r["orders"] for r in m.collect()} == {15}
    assert fieldwork.imbalance(m).first()["imbalance_pct"] < 25
    loads = [r["weight"] for r in m.collect()]
    assert max(loads) - min(loads) <= o.agg({"weight": "max"}).first()[0]
    capped = fieldwork.distribute(o, crews.union(crews), cap=10)
    assert capped.count() == 90 and capped.where("crew is null and leftover = 'CUPO'").count() == 30


def test_orders_without_crews_are_left_over_with_a_reason(spark):
    schema = "work_order int, unit string, weight double, x double, y double"
    o = spark.createDataFrame([(1, "U", 3.0, 0.0, 1.0), (2, "V", 5.0, 0.0, 1.0), (3, "V", None, None, 1.0), (4, None, 2.0, 1.0, 1.0), (5, "U", None, None, None)], schema)
    crews = spark.createDataFrame([("U", "a"), ("W", "b")], "unit string, crew string")
    got = {r["work_order"]: (r["crew"], r["tier"], r["leftover"]) for r in fieldwork.distribute(o, crews, cap=1).collect()}
    assert got == {1: ("a", 0, None), 5: (None, 1, "CUPO"), 2: (None, None, "SIN_CUADRILLA"), 3: (None, None, "SIN_CUADRILLA"), 4: (None, None, "SIN_CUADRILLA")}
    assert fieldwork.distribute(o, crews.limit(0)).where("leftover = 'SIN_CUADRILLA'").count() == 5
    assert fieldwork.distribute(o.limit(0), crews).count() == 0


def test_scope_fails_closed(spark):
    df = spark.createDataFrame([("F1", 1)], "feeder string, v int")
    assert fieldwork.scope(df, ["U"]).count() == 0
    assert fieldwork.scope(df, []).count() == 0
    assert fieldwork.scope(df, None, everything=True).count() == 1
    h = spark.createDataFrame([("F1", "U")], "feeder string, unit string")
    assert fieldwork.scope(df, ["U"], hierarchy=h).count() == 1


def test_scenario_reports_what_it_cannot_apply(spark):
    v = spark.createDataFrame([("F", "cliente", "1", "kwh", "10"), ("G", "cliente", "2", "kwh", "5")], "feeder string, layer string, element string, field string, value string")
    c = spark.createDataFrame([("s", 1, "cliente", "1", "MODIFICAR", "kwh", "20"), ("s", 2, "cliente", "1", "MODIFICAR", "kwh", "30"),
                               ("s", 3, "cliente", "9", "MODIFICAR", "kwh", "1"), ("s", 4, "cliente", "1", "CREAR", "kwh", "1")],
                              "scenario string, seq int, layer string, element string, operation string, field string, after string")
    assert rows(scenarios.overlay(v, c, ["cliente"]), "element", "value") == [("1", "30")]
    assert rows(scenarios.not_applied(c, v, ["cliente"]), "seq", "reason") == [(3, "ELEMENTO_AUSENTE"), (4, "OPERACION_NO_EVALUABLE")]


def test_relational_reader_options():
    o = readers.jdbc_options("postgres", host="h", port=5432, database="d", table="s.t", columns=["a", "b"], partition_column="a", lower=0, upper=9, sessions=4)
    assert o["dbtable"] == "(SELECT a, b FROM s.t) t" and o["numPartitions"] == "4" and o["url"].endswith("h:5432/d")
    with pytest.raises(ValueError):
        readers.jdbc_options("postgres", host="h", port=1, database="d", table="t; drop")
    with pytest.raises(ValueError):
        readers.jdbc_options("db9", host="h", port=1, database="d", table="t")


def test_readers_and_table_sink(spark, tmp_path):
    df = spark.range(120).withColumn("x", F.col("id") * 2)
    sinks.write_table(df, "readings_test")
    sinks.write_table(df, "readings_test", replace=False)
    assert spark.table("readings_test").count() == 240
    assert [len(b) for b in readers.batches(df, 50)] == [50, 50, 20]
    path = str(tmp_path / "p")
    sinks.write_result(df, path)
    with pytest.raises(ValueError):
        readers.read_parquet(spark, path, columns=["nope"])
    assert readers.read_parquet(spark, path, columns=["x"], limit=5).count() == 5
    _, errors = readers.read_sources({"bad": lambda: spark.read.parquet(str(tmp_path / "none"))})
    assert list(errors) == ["bad"]


def test_commercial_plan_finds_injected_theft(spark):
    """Six hundred customers, five per cent with a broken or zeroed series: most lie in the top of the ranking."""
    from wattledger.plans.commercial import analyse

    rng = np.random.default_rng(11)
    reg, reads, thieves = [], [], set()
    axis = series.month_axis(date(2026, 5, 1), 36)
    for i in range(600):
        base = float(rng.lognormal(5.3, 0.35))
        v = base * (1 + 0.15 * np.sin(np.arange(36) * np.pi / 6)) * rng.normal(1, 0.08, 36)
        if i % 20 == 0:
            thieves.add(i)
            if i % 40:
                v[22:] *= 0.35
            else:
                v[28:] = 0.0
        reg.append((i, "RESIDENCIAL BAJA TENSION", 1 + i % 2, f"R{i % 6}", f"T{i // 12}", True, 1.0, 0.3, "1"))
        reads += [(i, m, float(round(max(x, 0.0)))) for m, x in zip(axis, v)]
    register = spark.createDataFrame(reg, "account int, tariff string, phases int, route string, site string, active boolean, p_prev_kw double, q_prev_kvar double, division string")
    out = analyse(register, spark.createDataFrame(reads, "account int, period date, kwh double"), last_month=date(2026, 5, 1))
    top = {r["account"] for r in out["ranking"].where("rank <= 90").collect()}
    assert len(top & thieves) / len(thieves) >= 0.8
    assert out["reconciliation"].count() == 600 and out["signals"].count() == 600


def test_detached_loop_does_not_stop_the_fleet(spark):
    from wattledger.operators import network

    rows = [("A", "1", "r", "c", 1.0), ("A", "2", "a", "b", 1.0), ("A", "3", "b", "a", 1.0), ("B", "4", "r", "x", 1.0), ("B", "5", "x", "y", 1.0),
            ("C", "6", "r", "q", 1.0), ("C", "7", "z", "z", 1.0)]
    edges = spark.createDataFrame(rows, "feeder string, segment_id string, from_node string, to_node string, length_km double")
    sources = spark.createDataFrame([(f, "r") for f in "ABC"], "feeder string, source string")
    tree = network.orient(edges, sources)
    got = {(r.feeder, r.node): r.depth for r in tree.collect()}
    assert got == {("A", "r"): 0, ("A", "c"): 1, ("B", "r"): 0, ("B", "x"): 1, ("B", "y"): 2, ("C", "r"): 0, ("C", "q"): 1}
    assert {(r.feeder, r.node) for r in network.islands(edges, tree).collect()} == {("A", "a"), ("A", "b"), ("C", "z")}


def test_accounts_without_readings_stay(spark):
    from datetime import date

    from wattledger.operators import series

    register = spark.createDataFrame([(1,), (2,)], "account long")
    readings = spark.createDataFrame([(1, date(2001, 7, 1), 5.0)], "account long, period date, kwh double")
    rows = series.with_all_accounts(register, series.account_series(readings, date(2001, 7, 1), 3), 3)
    got = {r.account: r for r in series.representative_average(series.series_statistics(rows)).collect()}
    assert got[1].avg_kwh == 5.0 and (got[2].avg_kwh, got[2].n_valid, got[2].cv, got[2].reliable) == (0.0, 0, None, False)


def test_review_flags_rejected_propagation_of_an_accepted_element(spark):
    from wattledger.operators import journal

    changes = spark.createDataFrame([("P", 1, "e1", None), ("P", 2, "e2", 1), ("P", 3, "e3", None), ("P", 4, "e4", 3)], "package string, seq long, element string, propagated_from long")
    decisions = spark.createDataFrame([("P", 1, "ACEPTADO"), ("P", 2, "RECHAZADO"), ("P", 3, "RECHAZADO"), ("P", 4, "ACEPTADO")], "package string, seq long, decision string")
    findings = spark.createDataFrame([], "package string, severity string")
    got = {r.seq: (r.state, r.inconsistent) for r in journal.review(changes, decisions, findings).collect()}
    assert got == {1: ("ACEPTADO", False), 2: ("RECHAZADO", True), 3: ("RECHAZADO", False), 4: ("ACEPTADO", False)}


# --- work that follows the input, in many tasks ---------------------------------

def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_circles_look_at_few_points_outside_and_are_not_broadcast(spark):
    rng = np.random.default_rng(3)
    xy, c = rng.random((1500, 2)) * 1000, np.column_stack([rng.random((40, 2)) * 1000, rng.choice([0.0, 7.0, 90.0, 130.0, 250.0], 40)])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(9999, None, 1.0)], "p long, x double, y double")
    circles = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(c)] + [(50, float(xy[5, 0]), float(xy[5, 1]), 0.0)],
                                    "c long, cx double, cy double, radius double")
    joined = rangejoin.circle_join(points, circles)
    got = rows(joined, "p", "c")
    d = np.hypot(xy[:, None, 0] - c[None, :, 0], xy[:, None, 1] - c[None, :, 1])
    assert got == sorted([*map(tuple, np.argwhere(d <= c[None, :, 2]).tolist()), (5, 50)])
    assert rangejoin.circle_candidates(points, circles, x="x", y="y", cx="cx", cy="cy", radius="radius").count() < 2 * len(got)
    assert "BroadcastHashJoin" not in executed(joined)


def test_nearest_vertex_compares_places_and_sorts_no_pairs(spark):
    rng = np.random.default_rng(4)
    p, v = rng.integers(0, 30, (400, 2)), rng.integers(0, 30, (300, 2))     # many equal places and equal distances
    points = spark.createDataFrame([(i % 390, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(999, None, 1.0)], "p long, x double, y double")
    vertices = spark.createDataFrame([(int(k), float(x), float(y)) for k, (x, y) in zip(rng.permutation(300), v)], "v long, vx double, vy double")
    near = rangejoin.nearest_within(points, vertices, point_id="p", vertex_id="v", tolerance=2.0)
    want = {}
    for r in points.collect():
        for q in vertices.collect():
            if r.x is not None and (d := ((r.x - q.vx) ** 2 + (r.y - q.vy) ** 2) ** 0.5) <= 2.0:
                want[r.p] = min(want.get(r.p, (9.0, 0)), (d, q.v))
    assert {r.p: (r.distance, r.v) for r in near.collect()} == want
    assert not {"SortAggregate", "ObjectHashAggregate"} & set(executed(near).replace("(", " ").split())
    # Of two vertices at one place the one without an id comes first, as it did.
    pair = spark.createDataFrame([(None, 1.0, 1.0), (4, 1.0, 1.0)], "v long, vx double, vy double")
    assert rows(rangejoin.nearest_within(points.limit(0).unionByName(spark.createDataFrame([(1, 1.0, 1.5)], "p long, x double, y double")),
                                         pair, point_id="p", vertex_id="v"), "p", "v", "distance") == [(1, None, 0.5)]


def test_series_are_packed_by_one_aggregation_and_read_in_shuffled_tasks(spark):
    last = date(2001, 3, 1)
    long = spark.createDataFrame([(1, date(2001, 1, 1), 5.0), (1, date(2001, 1, 9), 7.0), (1, date(2001, 3, 31), None), (1, date(2001, 4, 1), 9.0),
                                  (2, date(2000, 12, 31), 1.0), (None, date(2001, 2, 1), 3.0)], "account long, period date, kwh double")
    packed = series.account_series(long, last, 3)
    assert {r.account: list(r.series) for r in packed.collect()} == {1: [7.0, None, None], None: [None, 3.0, None]}
    whole = series.with_all_accounts(spark.createDataFrame([(1,), (2,)], "account long"), packed, 3)
    assert {r.account: list(r.series) for r in whole.collect()} == {1: [7.0, None, None], 2: [None] * 3}
    assert "BroadcastHashJoin" not in executed(whole)


def test_a_catalogue_key_classifies_its_text_once(spark):
    keys = ["BT Residencial", "BT Comercial", "MT Industrial"]
    texts = ["RESIDENCIAL BAJA TENSION", "COMERCIAL MEDIA TENSION", "MT Industrial", "otro", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", classify.catalogue_key(F.col("t"), keys).alias("k"))
    assert {r.t: r.k for r in df.collect()} == dict(zip(texts, ["BT Residencial", "BT Comercial", "MT Industrial", None, None]))
    assert executed(df).count("POTABLE") == 1


def test_plausible_range_counts_known_means_of_known_classes(spark):
    df = spark.createDataFrame([("RESIDENCIAL BAJA TENSION", 10.0), ("RESIDENCIAL BAJA TENSION", 1e9), ("RESIDENCIAL BAJA TENSION", None),
                                ("COMERCIAL BAJA TENSION", None), ("otro", 5.0), (None, 5.0)], "tariff string, mean_kwh double")
    assert rows(series.plausible_range(df), "class_key", "customers", "pct_outside", "warning") == [("BT Residencial", 2, 50.0, True)]
