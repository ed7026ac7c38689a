"""Deterministic hash-derived values, written so that Spark and DuckDB compute the same numbers.

``uniform(x)`` maps a string to [0, 1) from the first 32 bits of its MD5 digest. The DuckDB spelling is
``duckdb_uniform`` (used by the SQL oracles and by tests).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def uniform(x: Column) -> Column:
    """u(x) in [0, 1): first 8 hex digits of md5(x) as an unsigned integer over 2^32."""
    return F.conv(F.substring(F.md5(x.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def uniform_py(text: str) -> float:
    """The same value computed in Python (used inside tasks, e.g. by the scorer stub)."""
    return int(hashlib.md5(text.encode("utf-8")).hexdigest()[:8], 16) / TWO_32


def duckdb_uniform(sql_expr: str) -> str:
    """DuckDB spelling of :func:`uniform` for a SQL expression."""
    return f"(CAST('0x' || substr(md5(CAST({sql_expr} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def sort_key(*parts: Column) -> Column:
    """Hex md5 of the parts joined by ':' — a stable, well-mixed ordering key."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
