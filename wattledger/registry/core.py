"""Registration of queries with their SQL counterparts.

``CTES`` holds named SQL fragments (``rec_`` marks a recursive one); ``compose`` prefixes a body with just the
fragments it mentions, in the order they were declared.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}
KEPT: set[str] = set()


def cte(name: str, body: str, kept: bool = False) -> None:
    """``kept`` fragments are computed once, however often they are read."""
    if name in CTES:
        raise ValueError(f"fragment {name} declared twice")
    CTES[name] = body.strip()
    if kept:
        KEPT.add(name)


def compose(body: str) -> str:
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"[a-z_][a-z0-9_]*", text)):
            if word in CTES and word not in needed:
                needed.add(word)
                visit(CTES[word])

    visit(body)
    parts = [f"{name} AS {'MATERIALIZED ' if name in KEPT else ''}(\n{CTES[name]}\n)" for name in CTES if name in needed]
    body = body.strip()
    if not parts:
        return body
    glue = ",\n" + body[4:] if body[:5].upper() == "WITH " else "\n" + body
    head = "WITH RECURSIVE " if any(n.startswith("rec_") for n in needed) else "WITH "
    return head + ",\n".join(parts) + glue


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def oracle() -> dict[str, str]:
    return {name: compose(body) for name, body in SQL.items()}
