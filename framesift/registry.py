"""Names of the library's own queries: name -> (function of session and folder, SQL for DuckDB or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_KNOWN: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function as the query `name`; `sql` gives the same rows in DuckDB."""

    def add(f: Query) -> Query:
        if name in _KNOWN:
            raise ValueError(f"query {name} is registered twice")
        _KNOWN[name] = (f, sql)
        return f

    return add


def functions() -> dict[str, Query]:
    return {k: f for k, (f, _) in _KNOWN.items()}


def statements() -> dict[str, str]:
    return {k: s for k, (_, s) in _KNOWN.items() if s}
