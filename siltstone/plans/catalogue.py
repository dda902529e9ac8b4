"""The catalogue of queries: name -> Spark function, and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query function and, where SQL can express it, its oracle."""

    def add(function: Query) -> Query:
        _QUERIES[name] = function
        if sql:
            _ORACLES[name] = sql
        return function

    return add


def _load() -> None:
    import importlib

    for module in ("crawl", "ledger", "jobs", "streams", "discovery"):
        importlib.import_module(f"siltstone.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
