"""Registry of the named queries and of the SQL each one is checked against.

A query module registers a function with ``@query(sql)``; the function's name is
the key. ``sql=None`` marks a query that SQL cannot express.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ["daily", "store", "series", "models", "documents", "more", "extra", "rules", "tables", "folders", "catalog", "asked", "records"]


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return add


def oracle_of(name: str) -> str:
    """The SQL of a query, for use inside another's."""
    _load()
    return _SQL[name]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"pulselake.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
