"""Named queries over the test tables, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, arrays: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Decorator: adds a query under a name; sql is its oracle. arrays: columns that both give as comma-separated text."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in arrays})

        _QUERIES[name] = run if arrays else f
        if sql is not None:
            flat = ", ".join(f"array_to_string({c}, ',') AS {c}" for c in arrays)
            _ORACLES[name] = f"SELECT * REPLACE ({flat}) FROM ({sql})" if arrays else sql
        return f

    return add


def _load() -> None:
    from . import bookkeeping_queries, evaluation_queries, function_queries, interval_queries, more_queries, planning_queries, run_queries, sampling_queries, source_queries, verdict_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["window_workload"](spark, sf_dir)
