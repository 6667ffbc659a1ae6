"""All queries of the core, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _counts(sql: str) -> str:
    """count_if as a count, which DuckDB gives as BIGINT."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + len('count_if('):end - 1]} THEN 1 END){sql[end:]}"
    return sql


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query, with the SQL that DuckDB runs on the same tables where there is one."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are called {name}")
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = _counts(sql)
        return query

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
