"""All registered queries of the core, by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def sql_utc(column: str) -> str:
    """SQL for a timestamp in UTC of a lenient ISO text; null if unreadable."""
    zone = r"'([+-]\d{2}):?(\d{2})$'"
    hours = f"coalesce(try_cast(regexp_extract({column}, {zone}, 1) AS INT), 0)"
    minutes = f"coalesce(try_cast(regexp_extract({column}, {zone}, 2) AS INT), 0)"
    sign = f"CASE WHEN regexp_extract({column}, {zone}, 1) LIKE '-%' THEN -1 ELSE 1 END"
    return rf"(try_cast(regexp_replace({column}, '(Z|[+-]\d{{2}}:?\d{{2}})$', '') AS TIMESTAMP) - to_minutes({hours} * 60 + ({sign}) * {minutes}))"


def register(sql: str | None = None, name: str | None = None):
    """Register a query, and the SQL whose rows it must equal."""

    def add(query):
        key = name or query.__name__
        assert key not in _QUERIES, key
        _QUERIES[key] = query
        if sql:
            _SQL[key] = sql
        return query

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    import importlib

    for module in ("references", "corpus", "chunks", "evaluation", "retrieval", "pages", "selection", "diagnostics", "pipelines"):
        importlib.import_module(f"tessitura.plans.{module}")
