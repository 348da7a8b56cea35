"""Query registry: ``name -> (builder(spark, sf_dir) -> DataFrame, oracle SQL)``."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
INVENTORY: dict[str, str] = {}


def register(name: str, ids: str, sql: str | None = None):
    """Register a query builder under ``name`` covering inventory ``ids``."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        INVENTORY[name] = ids
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco
