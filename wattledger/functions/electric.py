"""Electrical formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def average_power_kw(energy: Column, days: float) -> Column:
    if days <= 0:
        raise ValueError("days must be positive")
    return energy / F.lit(days * 24.0)


def velander_kw(energy: Column, a: Column, b: Column) -> Column:
    e = F.greatest(energy, F.lit(0.0))
    return a * e + b * F.sqrt(e)


def peak_by_load_factor(p_avg: Column, load_factor: Column) -> Column:
    return F.when(load_factor > 0, p_avg / load_factor)


def coincidence(n: Column, a: Column, b: Column, minimum: float = 0.0) -> Column:
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.greatest(a + b / F.sqrt(n), F.lit(minimum)))


def reactive_kvar(p: Column, cos_phi: Column) -> Column:
    return p * F.tan(F.acos(F.least(F.greatest(cos_phi, F.lit(1e-6)), F.lit(1.0))))


def apparent_kva(p: Column, q: Column) -> Column:
    return F.sqrt(p * p + q * q)


def current_a(s_kva: Column, phases: Column, v_ln: float, v_ll: float) -> Column:
    """Phase-neutral for one phase, phase-phase for two, three-phase otherwise."""
    va = s_kva * 1000.0
    n = F.coalesce(phases, F.lit(1))
    return (
        F.when(n <= 1, va / v_ln).when(n == 2, va / v_ll).otherwise(va / F.lit(math.sqrt(3.0) * v_ll))
    )


def loss_factor(load_factor: Column, k: Column) -> Column:
    return k * load_factor + (F.lit(1.0) - k) * load_factor * load_factor


def resistance_at(r20: Column, temperature: float, alpha: float, reference: float = 20.0) -> Column:
    return r20 * F.lit(1.0 + alpha * (temperature - reference))
