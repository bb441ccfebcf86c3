"""Radial load flow of all feeders at once, in bulk-synchronous sweeps.

A sweep is: node currents from the present voltages, subtree sums (branch
currents), path sums of the drops (new voltages). Nodes are numbered in tour order,
so both are prefix sums over ranges of places (``operators.tours``): one row a range,
two passes a sweep, whatever the depth and the number of feeders. Every feeder
converges by itself: it is frozen at the sweep that settled it, and only the others
are swept again. Complex numbers are (re, im) column pairs in what is returned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattledger.operators import tours
from wattledger.operators.losses import phase_imbalance_pct
from wattledger.operators.network import KEY
from wattledger.operators.tours import in_blocks
from wattledger.staging import stage

_ANGLE = [0.0, -2.0 * math.pi / 3.0, 2.0 * math.pi / 3.0]


def _tan(pf: Column) -> Column:
    f = F.least(F.greatest(F.coalesce(pf, F.lit(0.92)), F.lit(0.1)), F.lit(1.0))
    return F.sqrt(1.0 - f * f) / f


def impedances(tree: DataFrame, edges: DataFrame, conductors: DataFrame, *, t_op: float = 50.0, alpha: float = 0.00403,
               t_ref: float = 20.0) -> DataFrame:
    """Tree with ``r`` and ``x`` (ohm) of the segment into each node; unknown conductors get 0.01."""
    cat = conductors.select(F.col("code").alias("conductor"), "r_ohm_km", "x_ohm_km")
    # One row a segment: a name used twice in a feeder must not double its nodes.
    one = edges.groupBy("feeder", "segment_id").agg(F.min(F.struct("conductor", "n_phases", "voltage_v")).alias("m")).select("feeder", "segment_id", "m.*")
    seg = one.join(cat, "conductor", "left")
    warm = 1.0 + alpha * (t_op - t_ref)
    return tree.join(seg, ["feeder", "segment_id"], "left").select(
        *KEY, "parent", "segment_id", "length_km", "n_phases", "voltage_v", "place", "size",
        F.when(F.col("parent").isNotNull(), F.coalesce(F.col("r_ohm_km") * warm, F.lit(0.01)) * F.col("length_km")).otherwise(0.0).alias("r"),
        F.when(F.col("parent").isNotNull(), F.coalesce(F.col("x_ohm_km"), F.lit(0.01)) * F.col("length_km")).otherwise(0.0).alias("x"),
    )


def base_voltages(tree_z: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(feeder, v0)``: phase-neutral volts of the first segment at the source."""
    s = sources.select("feeder", "source")
    at = edges.join(s, "feeder").where((F.col("from_node") == F.col("source")) | (F.col("to_node") == F.col("source")))
    v = at.groupBy("feeder").agg(F.min_by("voltage_v", "segment_id").alias("v"))
    return s.join(v, "feeder", "left").select("feeder", (F.coalesce("v", F.lit(13800.0)) / math.sqrt(3.0)).alias("v0"))


def _ranges(batches):
    """Rows of Arrow batches, one at a time as they are large, each with its batch's schema."""
    with np.errstate(all="ignore"):
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.schema, SimpleNamespace(**batch.slice(k, 1).to_pylist()[0])


class _Blocks:
    """The sweeps of all feeders over rows that each hold a range of places (``operators.tours.BLOCK``) as packed arrays.

    A row has what does not change (where subtrees stop, impedances, powers) and the voltages, so a sweep moves no node: it
    reads the rows, and ranges of one feeder exchange their totals and, for subtrees that end in another range, one value
    for each place where some do. A range whose feeder it is alone is swept to its end in its task. Powers, voltages
    and currents are complex, one line of an array a phase.
    """

    STATE = "block long, n int, stop binary, z binary, power binary, v0 double, far array<struct<to: long, places: binary>>"
    ASKED = "asked array<struct<`from`: long, places: binary>>"
    SENT = "block long, total binary, to long, `from` long, part binary"

    def __init__(self, phases: int, tolerance: float, max_sweeps: int, mutual: float = 0.0):
        self.phases, self.mutual, self.tolerance, self.max_sweeps, self.width = phases, mutual, tolerance, max_sweeps, tours.BLOCK

    # --- in one range

    def source(self, v0: float) -> np.ndarray:
        return v0 * np.array([complex(math.cos(a), math.sin(a)) for a in _ANGLE[:self.phases]])[:, None]

    def complexes(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, complex).reshape(self.phases, -1)

    def currents(self, r, v: np.ndarray) -> np.ndarray:
        """conj(S / V) of every place, with the places before summed up: entry k is the sum over the places before k."""
        power = self.complexes(r.power)
        mag = v.real ** 2 + v.imag ** 2
        live = (power != 0) & ~(mag <= 1e-12)
        drawn = np.where(live, power.conj() * v / np.where(live, mag, 1.0), 0.0)
        return np.concatenate([np.zeros((self.phases, 1), complex), np.cumsum(drawn, axis=1)], axis=1)

    def drops(self, r, branch: np.ndarray) -> np.ndarray:
        z = np.frombuffer(r.z, complex)
        own = branch * z
        if self.phases > 1:  # own impedance r + jx, mutual j * mutual * x to the other phases
            own = own + 1j * self.mutual * z.imag * (branch.sum(axis=0) - branch)
        return own

    def stops(self, r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places after the subtrees, counted from the range's first; which lie in the range (or at the feeder's end in it); their ranges."""
        stop = np.frombuffer(r.stop, np.int64)
        to = stop // self.width + r.block
        return stop, to == r.block, to

    def branches(self, r, v: np.ndarray, totals: np.ndarray | None = None, parts: dict | None = None) -> np.ndarray:
        """Currents into the places: the sums over their subtrees. ``parts``: by range, its sums before the places asked for."""
        before = self.currents(r, v)
        stop, inside, to = self.stops(r)
        end = before[:, np.where(inside, stop, r.n)]
        for f in r.far:
            asked = np.frombuffer(f["places"], np.int64)
            here = np.flatnonzero(to == f["to"])
            # Missing: a place right behind the feeder's last range.
            beyond = (parts or {}).get(f["to"], np.zeros((self.phases, len(asked)), complex))
            between = 0.0 if totals is None else totals[:, r.block + 1:f["to"]].sum(axis=1)[:, None]
            end[:, here] += between + beyond[:, np.searchsorted(asked, stop[here] % self.width)]
        return end - before[:, :r.n]

    def net(self, r, drop: np.ndarray) -> np.ndarray:
        """What a place adds to the path sums of the places from there on: its drop, less those of the subtrees that stop there."""
        stop, inside, _ = self.stops(r)
        out = np.zeros((self.phases, r.n + 1), complex)
        for k in range(self.phases):
            off = [np.bincount(stop[inside], part[inside], r.n + 1) for part in (drop[k].real, drop[k].imag)]
            out[k] = -(off[0] + 1j * off[1])
        out[:, :r.n] += drop
        return out

    def pack(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place").drop_duplicates("place")
        block = int(rows["block"].iloc[0])
        stop = rows["stop"].to_numpy(np.int64) - block * self.width
        far = stop[stop // self.width > 0]
        asked = [{"to": int(t) + block, "places": np.unique(far[far // self.width == t] % self.width).tobytes()} for t in np.unique(far // self.width)]
        z = rows["r"].to_numpy(float) + 1j * rows["x"].to_numpy(float)
        power = np.stack([rows[f"p{k}"].to_numpy(float) + 1j * rows[f"q{k}"].to_numpy(float) for k in range(self.phases)])
        return pd.DataFrame({
            "feeder": rows["feeder"].iloc[:1].to_numpy(), "block": [block], "n": [len(rows)], "stop": [stop.tobytes()], "z": [z.tobytes()],
            "power": [power.tobytes()], "v0": [float(rows["v0"].iloc[0])], "far": [asked]})

    def voltages(self, r, drop: np.ndarray, before: np.ndarray, parts: dict) -> np.ndarray:
        """Source voltage less the drops along the paths. ``before``: what the ranges before add; ``parts``: what subtrees
        of other ranges take off here."""
        net = self.net(r, drop)
        for asker in r.asked or []:
            if asker["from"] in parts:
                net[:, np.frombuffer(asker["places"], np.int64)] -= parts[asker["from"]]
        return self.source(r.v0) - before[:, None] - np.cumsum(net, axis=1)[:, :r.n]

    def change(self, r, old: np.ndarray, new: np.ndarray) -> float:
        return float(np.max(np.abs(new - old)) / r.v0) if r.v0 else math.nan

    def columns(self, kind: pa.Schema, r, v: np.ndarray, i: np.ndarray, converged: bool, iterations: int) -> pa.RecordBatch:
        out = {"feeder": pa.repeat(pa.scalar(r.feeder, kind.field("feeder").type), r.n), "place": pa.array(np.arange(r.n) + r.block * self.width)}
        for k in range(self.phases):
            out |= {f"{c}{k}": pa.array(np.ascontiguousarray(a)) for c, a in (("vr", v[k].real), ("vi", v[k].imag), ("ir", i[k].real), ("ii", i[k].imag))}
        out |= {"converged": pa.repeat(pa.scalar(bool(converged)), r.n), "iterations": pa.repeat(pa.scalar(iterations, pa.int32()), r.n)}
        return pa.RecordBatch.from_arrays(list(out.values()), list(out))

    def alone(self, batches):
        """Feeders of one range, swept to the end."""
        for kind, r in _ranges(batches):
            v = np.repeat(self.source(r.v0), r.n, axis=1)
            for sweep in range(1, self.max_sweeps + 1):
                i = self.branches(r, v)
                new = self.source(r.v0) - np.cumsum(self.net(r, self.drops(r, i)), axis=1)[:, :r.n]
                worst, v = self.change(r, v, new), new
                if worst < self.tolerance or math.isnan(worst):
                    break
            yield self.columns(kind, r, v, i, worst < self.tolerance, sweep)

    # --- between ranges

    def received(self, r, which: str) -> tuple[np.ndarray, dict]:
        """Totals by range of the feeder, and the parts sent by the range that sent them."""
        listed = getattr(r, f"totals{which}")
        totals = np.zeros((self.phases, max(t["block"] for t in listed) + 1), complex)
        for t in listed:
            for raw in t["totals"]:
                totals[:, t["block"]] += np.frombuffer(raw, complex)
        return totals, {p["from"]: self.complexes(p["part"]) for p in getattr(r, f"parts{which}") or []}

    def sent(self, kind: pa.Schema, r, rows: list[tuple]) -> pa.RecordBatch:
        out = pa.schema([kind.field("feeder"), ("block", pa.int64()), ("total", pa.binary()), ("to", pa.int64()), ("from", pa.int64()), ("part", pa.binary())])
        return pa.RecordBatch.from_pylist([dict(zip(out.names, (r.feeder, *row))) for row in rows], out)

    def state(self, kind: pa.Schema, r, v: np.ndarray, worst: float) -> pa.RecordBatch:
        kept = [f for f in kind if f.name in ("feeder", "block", "n", "stop", "z", "power", "v0", "far", "asked")]
        out = pa.schema([*kept, ("v", pa.binary()), ("worst", pa.float64())])
        return pa.RecordBatch.from_pylist([{**{f.name: getattr(r, f.name) for f in kept}, "v": np.ascontiguousarray(v).tobytes(), "worst": worst}], out)

    def begin(self, batches):
        for kind, r in _ranges(batches):
            yield self.state(kind, r, np.repeat(self.source(r.v0), r.n, axis=1), math.nan)

    def sum_up(self, batches):
        """Sent: a range's total, and for the ranges that asked, its sums before their places."""
        for kind, r in _ranges(batches):
            before = self.currents(r, self.complexes(r.v))
            yield self.sent(kind, r, [(r.block, before[:, r.n].tobytes(), None, None, None)] + [
                (None, None, a["from"], r.block, before[:, np.frombuffer(a["places"], np.int64)].tobytes()) for a in r.asked or []])

    def take_off(self, batches):
        """Sent: a range's net drop, and what its subtrees take off at their stops in other ranges."""
        for kind, r in _ranges(batches):
            drop = self.drops(r, self.branches(r, self.complexes(r.v), *self.received(r, "1")))
            rows = [(r.block, self.net(r, drop)[:, :r.n].sum(axis=1).tobytes(), None, None, None)]
            stop, _, to = self.stops(r)
            for f in r.far:
                asked = np.frombuffer(f["places"], np.int64)
                here = np.flatnonzero(to == f["to"])
                at = np.searchsorted(asked, stop[here] % self.width)
                part = np.stack([np.bincount(at, d[here].real, len(asked)) + 1j * np.bincount(at, d[here].imag, len(asked)) for d in drop])
                rows.append((f["to"], (-part.sum(axis=1)).tobytes(), f["to"], r.block, part.tobytes()))
            yield self.sent(kind, r, rows)

    def settle(self, batches, emit: bool):
        """The ranges with new voltages and their largest change, or (``emit``) their places."""
        for kind, r in _ranges(batches):
            v = self.complexes(r.v)
            i = self.branches(r, v, *self.received(r, "1"))
            totals, parts = self.received(r, "2")
            new = self.voltages(r, self.drops(r, i), totals[:, :r.block].sum(axis=1), parts)
            yield self.columns(kind, r, new, i, r.converged, r.iterations) if emit else self.state(kind, r, new, self.change(r, v, new))

    def deliver(self, state: DataFrame, sent: DataFrame, which: str) -> DataFrame:
        """``state`` with the totals of its feeder's ranges and the parts sent to the range."""
        totals = sent.where("total is not null").groupBy("feeder", "block").agg(F.collect_list("total").alias("totals")).groupBy("feeder").agg(
            F.collect_list(F.struct("block", "totals")).alias(f"totals{which}"))
        parts = sent.where("to is not null").groupBy("feeder", F.col("to").alias("block")).agg(F.collect_list(F.struct("from", "part")).alias(f"parts{which}"))
        return state.join(totals, "feeder").join(parts, ["feeder", "block"], "left")

    def run(self, nodes: DataFrame) -> DataFrame:
        """``feeder, place``, per phase ``vr, vi, ir, ii``, ``converged, iterations``.

        ``nodes``: feeder, place, stop, block, r, x, v0, and ``p`` and ``q`` with the number of the phase (from 0).
        """
        key = f"feeder {dict(nodes.dtypes)['feeder']}"
        values = ", ".join(f"{c}{k} double" for k in range(self.phases) for c in ("vr", "vi", "ir", "ii"))
        places, sent = f"{key}, place long, {values}, converged boolean, iterations int", f"{key}, {self.SENT}"
        state = f"{key}, {self.STATE}, {self.ASKED}, v binary, worst double"
        packed = stage(nodes.groupBy("feeder", "block").applyInPandas(lambda rows: self.pack(rows), f"{key}, {self.STATE}"), "ranges")
        many = packed.groupBy("feeder").agg(F.max("block").alias("__last")).where("__last > 0").select("feeder")
        done = packed.join(many, "feeder", "left_anti").mapInArrow(self.alone, places)
        if many.isEmpty():
            return done
        asked = packed.select("feeder", F.col("block").alias("from"), F.inline("far")).groupBy("feeder", F.col("to").alias("block")).agg(
            F.collect_list(F.struct("from", "places")).alias("asked"))
        now = stage(packed.join(many, "feeder", "left_semi").join(asked, ["feeder", "block"], "left").mapInArrow(self.begin, state), "ranges")
        for sweep in range(1, self.max_sweeps + 1):
            summed = self.deliver(now.drop("worst"), stage(now.mapInArrow(self.sum_up, sent), "sent"), "1")
            both = self.deliver(summed, stage(summed.mapInArrow(self.take_off, sent), "sent"), "2")
            now = stage(both.mapInArrow(lambda batches: self.settle(batches, False), state), "ranges")
            ended = (F.col("worst") < self.tolerance) | F.isnan("worst") | F.lit(sweep >= self.max_sweeps)
            verdict = stage(now.groupBy("feeder").agg(F.max("worst").alias("worst")).select(
                "feeder", (F.col("worst") < self.tolerance).alias("converged"), F.lit(sweep).alias("iterations"), ended.alias("through")), "verdict")
            through, open_ = verdict.agg(F.count_if("through"), F.count_if(~F.col("through"))).first()
            if through:
                rows = both.join(verdict.where("through").drop("through"), "feeder")
                done = done.unionByName(rows.mapInArrow(lambda batches: self.settle(batches, True), places))
            if not open_:
                break
            if through:
                now = now.join(verdict.where("not through").select("feeder"), "feeder", "left_semi")
        return done


_PLACE = ["place", "stop", "block"]


def balanced_flow(tree_z: DataFrame, loads: DataFrame, base: DataFrame, levels: Sequence[DataFrame] | None = None, *,
                  tolerance: float = 1e-6, max_sweeps: int = 100) -> DataFrame:
    """``(feeder, node, v_re, v_im, i_re, i_im, v0, r, x, converged, iterations)``.

    ``loads``: feeder, node, kw (three-phase), pf. A feeder is swept until its own
    largest voltage change is below tolerance, whatever the others do. ``levels``
    are not needed.
    """
    p = F.coalesce("kw", F.lit(0.0)) * 1000.0 / 3.0
    nodes = stage(in_blocks(tree_z).join(loads, KEY, "left").join(base, "feeder").select(
        *KEY, "parent", "segment_id", *_PLACE, "r", "x", "v0", p.alias("p"), (p * _tan(F.col("pf"))).alias("q")), "flow")
    done = _Blocks(1, tolerance, max_sweeps).run(nodes.select("feeder", *_PLACE, "r", "x", "v0", F.col("p").alias("p0"), F.col("q").alias("q0")))
    return stage(nodes.join(done.withColumnsRenamed({"vr0": "v_re", "vi0": "v_im", "ir0": "i_re", "ii0": "i_im"}), ["feeder", "place"]), "flow")


def flow_summary(flow: DataFrame) -> DataFrame:
    """Peak loss, lowest voltage and largest branch current per feeder."""
    i2 = F.col("i_re") * F.col("i_re") + F.col("i_im") * F.col("i_im")
    v = F.sqrt(F.col("v_re") * F.col("v_re") + F.col("v_im") * F.col("v_im"))
    return flow.groupBy("feeder").agg(
        (F.sum(3.0 * i2 * F.col("r")) / 1000.0).alias("loss_kw_peak"), F.min(v / F.col("v0")).alias("v_min_pu"),
        F.max(F.when(F.col("segment_id").isNotNull(), F.sqrt(i2))).alias("i_max_a"), F.bool_and("converged").alias("converged"),
        F.max("iterations").alias("iterations"))


def flow_residuals(flow: DataFrame) -> DataFrame:
    """How far a balanced flow is from its equations, per feeder, by joins of every node with its parent.

    ``drop_pu``: largest |V_parent - V - I Z| over V0; ``current_pu``: what enters at the source less what the nodes draw at
    their voltages, over the former; ``power_pu``: what the source feeds less loads and losses, over the loads.
    """
    c = F.col
    up = flow.select("feeder", c("node").alias("parent"), c("v_re").alias("__re"), c("v_im").alias("__im"))
    rows = flow.join(up, ["feeder", "parent"], "left")
    below = c("parent").isNotNull()
    d_re = c("__re") - c("v_re") - (c("i_re") * c("r") - c("i_im") * c("x"))
    d_im = c("__im") - c("v_im") - (c("i_re") * c("x") + c("i_im") * c("r"))
    mag = c("v_re") * c("v_re") + c("v_im") * c("v_im")
    at_source = lambda x: F.sum(F.when(~below, x).otherwise(0.0))
    out = rows.groupBy("feeder").agg(
        F.count_if(below).alias("segments"), F.max(F.when(below, F.sqrt(d_re * d_re + d_im * d_im) / c("v0"))).alias("drop_pu"),
        (at_source(c("i_re")) - F.sum((c("p") * c("v_re") + c("q") * c("v_im")) / mag)).alias("__di_re"),
        (at_source(c("i_im")) - F.sum((c("p") * c("v_im") - c("q") * c("v_re")) / mag)).alias("__di_im"),
        at_source(F.sqrt(c("i_re") ** 2 + c("i_im") ** 2)).alias("__i"), at_source(c("i_re") * c("v_re") + c("i_im") * c("v_im")).alias("__fed"), F.sum("p").alias("__p"),
        F.sum(F.when(below, (c("i_re") ** 2 + c("i_im") ** 2) * c("r")).otherwise(0.0)).alias("__loss"))
    return out.select(
        "feeder", "segments", F.coalesce("drop_pu", F.lit(0.0)).alias("drop_pu"), F.coalesce(F.sqrt(c("__di_re") ** 2 + c("__di_im") ** 2) / F.nullif(c("__i"), F.lit(0.0)), F.lit(0.0)).alias("current_pu"),
        F.coalesce(F.abs(c("__fed") - c("__p") - c("__loss")) / F.nullif(c("__p"), F.lit(0.0)), F.lit(0.0)).alias("power_pu"))


def branch_currents(flow: DataFrame) -> DataFrame:
    return flow.where(F.col("segment_id").isNotNull()).select(
        "feeder", "segment_id", F.sqrt(F.col("i_re") ** 2 + F.col("i_im") ** 2).alias("current_a"))


def loads_by_phase(customers: DataFrame, kw: Column) -> DataFrame:
    """kW per node and phase A, B, C; an unreadable phase counts as A.

    ``phase`` is the sequence number of the connected phase (1, 2, 3).
    """
    ph = F.when(F.col("phase") == 2, 1).when(F.col("phase") == 3, 2).otherwise(0)
    return customers.groupBy(*KEY).agg(*[
        F.sum(F.when(ph == i, kw).otherwise(0.0)).alias(f"kw_{c}") for i, c in enumerate("abc")])


def unbalanced_flow(tree_z: DataFrame, loads: DataFrame, base: DataFrame, levels: Sequence[DataFrame] | None = None, *,
                    pf: float = 0.92, mutual: float = 0.4, tolerance: float = 1e-6, max_sweeps: int = 100) -> DataFrame:
    """Three-phase flow with mutual reactance ``mutual * x``; columns suffixed _a, _b, _c. ``levels`` are not needed."""
    t = float(math.sqrt(1 - min(max(pf, 0.1), 1.0) ** 2) / min(max(pf, 0.1), 1.0))
    ph = "abc"
    nodes = stage(in_blocks(tree_z).join(loads, KEY, "left").join(base, "feeder").select(
        *KEY, "parent", "segment_id", *_PLACE, "length_km", "n_phases", "r", "x", "v0",
        *[(F.coalesce(f"kw_{c}", F.lit(0.0)) * 1000.0).alias(f"p_{c}") for c in ph]), "flow3")
    powers = [x for k, c in enumerate(ph) for x in (F.col(f"p_{c}").alias(f"p{k}"), (F.col(f"p_{c}") * t).alias(f"q{k}"))]
    done = _Blocks(3, tolerance, max_sweeps, mutual).run(nodes.select("feeder", *_PLACE, "r", "x", "v0", *powers))
    named = {f"{x}{k}": f"{x}_{c}" for k, c in enumerate(ph) for x in ("vr", "vi", "ir", "ii")}
    return stage(nodes.join(done.withColumnsRenamed(named), ["feeder", "place"]), "flow3")


def unbalanced_summary(flow: DataFrame, *, r_neutral_km: float = 0.86, min_share: float = 0.10) -> DataFrame:
    """Phase and neutral loss, lowest voltage, imbalance of the loaded three-phase segments."""
    mag = {c: F.sqrt(F.col(f"ir_{c}") ** 2 + F.col(f"ii_{c}") ** 2) for c in "abc"}
    seg = F.col("segment_id").isNotNull()
    i2 = sum((F.col(f"ir_{c}") ** 2 + F.col(f"ii_{c}") ** 2 for c in "abc"), F.lit(0.0))
    n2 = (F.col("ir_a") + F.col("ir_b") + F.col("ir_c")) ** 2 + (F.col("ii_a") + F.col("ii_b") + F.col("ii_c")) ** 2
    mean = (mag["a"] + mag["b"] + mag["c"]) / 3.0
    rows = flow.withColumns({
        "__phase": F.when(seg, i2 * F.col("r")).otherwise(0.0),
        "__neutral": F.when(seg, n2 * F.col("length_km") * r_neutral_km).otherwise(0.0),
        "__mean": F.when(seg & (F.col("n_phases") == 3), mean),
        "__imb": phase_imbalance_pct(mag["a"], mag["b"], mag["c"]),
        "__v": F.least(*[F.sqrt(F.col(f"vr_{c}") ** 2 + F.col(f"vi_{c}") ** 2) for c in "abc"]) / F.col("v0"),
    })
    top = rows.groupBy("feeder").agg(F.max("__mean").alias("__top"))
    loaded = (F.col("__mean") > 0) & (F.col("__mean") >= min_share * F.col("__top"))
    return rows.join(top, "feeder").groupBy("feeder").agg(
        (F.sum("__phase") / 1000.0).alias("loss_phases_kw"), (F.sum("__neutral") / 1000.0).alias("loss_neutral_kw"),
        F.min("__v").alias("v_min_pu"), F.coalesce(F.max(F.when(loaded, F.col("__imb"))), F.lit(0.0)).alias("imbalance_pct_max"),
        F.bool_and("converged").alias("converged"), F.max("iterations").alias("iterations"),
    ).withColumn("loss_kw_peak", F.col("loss_phases_kw") + F.col("loss_neutral_kw"))
