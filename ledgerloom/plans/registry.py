"""Names every query and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: add a query and, where SQL can express it, its oracle."""

    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    from ledgerloom.plans import catalog  # noqa: F401  (importing it fills the registry)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from ledgerloom.plans import catalog  # noqa: F401

    return dict(_ORACLES)
