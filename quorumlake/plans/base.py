"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQLS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame; sql: its equivalent over the driver tables."""
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQLS[name] = sql
        return f

    return keep
