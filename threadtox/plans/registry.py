"""Registry of named queries: each has a Spark builder ``(spark, data_dir) -> DataFrame`` and, when the
operation is expressible in SQL, a DuckDB oracle over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    survey: str          # inventory row(s) it covers, e.g. "X1" or "A1"
    heavy: bool = False  # trains models: left out of the default bench


QUERIES: dict[str, Query] = {}


def register(name: str, survey: str, sql: str | None = None, heavy: bool = False):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, survey, heavy)
        return fn
    return deco
