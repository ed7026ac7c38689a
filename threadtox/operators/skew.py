"""Joins on keys of which a few may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000   # a key is hot if it has more than one in so many rows; there are fewer hot keys than that


def lookup_join(left: DataFrame, right: DataFrame, key: str, right_key: str, hot_share: int = HOT_SHARE) -> DataFrame:
    """Left join of ``left`` with ``right``, which has at most one row a key, on ``key = right_key`` (dropped).

    The keys of ``left`` are counted first, map-side. Rows of the hot ones meet a broadcast of those keys' rows, at
    most ``hot_share``, and never leave their task; the rest is an ordinary join. Null keys meet nothing.
    """
    total = left.count()
    counts = left.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__n"))
    hot = [r[0] for r in counts.filter(F.col("__n") * hot_share > total).select("__hot").collect()]
    right = right.withColumnRenamed(right_key, "__right")
    if not hot:
        return left.join(right, left[key] == right["__right"], "left").drop("__right")
    keys = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in hot], f"__right {left.schema[key].dataType.simpleString()}"))
    few = F.broadcast(right.join(keys, "__right", "left_semi"))
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    spread = left.filter(is_hot).join(few, F.col(key) == F.col("__right"), "left").drop("__right")
    rest = left.filter(~is_hot)
    return spread.unionByName(rest.join(right, rest[key] == right["__right"], "left").drop("__right"))
