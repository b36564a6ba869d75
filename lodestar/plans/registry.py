"""The registered queries of the attention and entity operators, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("panels", "series", "entities", "cohorts", "statistics", "merges", "texts", "scans", "streams")


def query(name: str, sql: str | None = None):
    """Register a function of a Tables object as a query; sql is the same in DuckDB's dialect."""

    def keep(f):
        from .bindings import Tables

        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
