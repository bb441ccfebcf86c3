"""Queries over the driver's tables, one per operator, with equivalent SQL."""

from __future__ import annotations

import importlib

MODULES = ["customers", "energy", "evidence", "grid", "field", "io"]


def load():
    """``(queries, sql)`` of every registry module."""
    from wattledger.registry import core

    for module in MODULES:
        importlib.import_module(f"wattledger.registry.{module}")
    return dict(core.QUERIES), core.oracle()
