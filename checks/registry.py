"""Collects the registered queries: each module holds functions and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None, longs: str = "") -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL; `longs` names integer columns to widen there."""
    def add(query: Query) -> Query:
        key = query.__name__
        assert key not in _QUERIES, key
        _QUERIES[key] = query
        if sql is not None:
            wide = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in longs.split())
            _SQL[key] = f"SELECT * REPLACE ({wide}) FROM ({sql})" if wide else sql
        return query

    return add


def _load() -> None:
    from checks import derived_queries, frontier_queries, option_queries, page_queries, store_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
