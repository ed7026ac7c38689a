"""Small helpers that the operators share: tables, written intermediates, Arrow mappers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadtox.session import materialize, ship_package
from threadtox.sources.tables import table

__all__ = ["arrow_map", "has", "materialize", "table", "typed"]


def typed(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast to the given types; any other column of ``df`` is left out."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()))


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from f(b)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def has(spark: SparkSession, path: str) -> bool:
    """Whether a table folder or file can be read at ``path``."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))
