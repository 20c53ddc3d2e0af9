"""Registration of queries; modules are imported on first use."""
from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("keys", "aggregates", "windows", "cross", "orderflow", "priceflow", "scoring", "validation",
            "filings", "ingest", "jobs", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"tapeworks.plans.catalog.{m}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def R(expr: str, digits: int) -> str:
    """SQL twin of ``rounded``: half-up through a 10-digit decimal."""
    return f"CAST(round(CAST({expr} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"
