"""Named queries over the driver's tables, and the SQL each must agree with.

A query is registered with @query(sql); those whose result SQL cannot express give none and are tested against
brute force or golden values instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def _load() -> None:
    from tidemark.plans import analysis_queries, core_queries, evidence_queries, report_queries, scalar_queries, sheet_queries, source_queries, stream_queries, table_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
