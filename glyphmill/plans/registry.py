"""All queries of the engine and their SQL. Plan modules register by the query decorator."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("corpus", "text", "arrays", "tokenizers", "packing", "evaluation", "logs", "reports", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql is DuckDB SQL with the same columns, None where SQL cannot express it."""

    def register(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"glyphmill.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
