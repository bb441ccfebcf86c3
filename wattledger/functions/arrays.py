"""SQL fragments over ``array<double>`` columns.

A customer's series is bounded by the number of months on the axis, so it is kept
as one array per account. Every per-customer statistic is then a projection: no
further shuffle, no window sort.
"""

from __future__ import annotations


def total(a: str) -> str:
    return f"aggregate({a}, 0D, (acc, x) -> acc + x)"


def mean(a: str) -> str:
    return f"({total(a)} / nullif(size({a}), 0))"


def std_pop(a: str, m: str) -> str:
    """Population deviation around ``m`` (the mean of ``a``)."""
    return f"sqrt(aggregate({a}, 0D, (acc, x) -> acc + (x - {m}) * (x - {m})) / nullif(size({a}), 0))"


def quantile_sorted(s: str, p: float) -> str:
    """Linear-interpolation quantile of a sorted array."""
    pos = f"((size({s}) - 1) * {p!r}D)"
    lo = f"get({s}, cast(floor({pos}) as int))"
    hi = f"get({s}, cast(ceil({pos}) as int))"
    return f"if(size({s}) > 0, {lo} + ({hi} - {lo}) * ({pos} - floor({pos})), null)"


def median_sorted(s: str) -> str:
    return f"((get({s}, cast((size({s}) - 1) div 2 as int)) + get({s}, cast(size({s}) div 2 as int))) / 2D)"
