"""Exact ordered running totals without a window over one huge partition.

``row_number() OVER (PARTITION BY p ORDER BY o)`` puts every row of a partition key into one task. When a
key is hot (one split holds all rows of the comment table; one global AUROC holds every distinct score) that
task does all the work. The operators here compute the same numbers in two levels:

1. the caller gives bucket columns ``b`` whose order agrees with ``o`` (a monotone coarsening, e.g. a
   hash prefix, ``id >> k`` or a score range); per (p, b) we sum the values — a small table, aggregated
   map-side first;
2. a window over that small table gives each bucket the total of all earlier buckets (its offset);
3. a window partitioned by (p, b) — bounded by bucket size, spread over many tasks — gives the running
   total inside the bucket; offset + local total is the exact answer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ENDS = 1 << 20   # most bucket ends (about 50 bytes each) that are broadcast


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], broadcast_right: bool) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    if broadcast_right:
        r = F.broadcast(r)
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, "inner").drop(*[f"__r_{k}" for k in keys])


def running_totals(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column],
                   bucket_by: Sequence[Column], values: Mapping[str, Column], *,
                   totals: bool = False, bounded_buckets: bool = False) -> DataFrame:
    """Add, for each name in ``values``, the sum of that value over the rows strictly before this row
    (same ``partition_by`` key, ``order_by`` order). With ``totals`` also add ``total_<name>`` per key.

    ``bucket_by`` must be a monotone coarsening of ``order_by``. ``bounded_buckets`` says the caller can bound
    the number of (key, bucket) pairs (e.g. splits x 16^k), which allows broadcasting the offset table;
    otherwise the join strategy is left to AQE, which broadcasts it once its real size is known.
    """
    pcols = list(partition_by)
    bnames = [f"__b{i}" for i in range(len(bucket_by))]
    vnames = list(values)
    d = df.select("*", *[b.alias(n) for n, b in zip(bnames, bucket_by)],
                  *[values[v].alias(f"__v_{v}") for v in vnames])
    keys = pcols + bnames

    # One shuffle on (p, b) feeds everything: the running total inside the bucket and the bucket total
    # come from the same window pass, and the bucket table is aggregated from that already-partitioned
    # output, so the input is read once (both consumers share the exchange).
    bucket = Window.partitionBy(*keys)
    inside = bucket.orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    local = d.select("*", *[F.coalesce(F.sum(f"__v_{v}").over(inside), F.lit(0)).alias(f"__l_{v}") for v in vnames],
                     *[F.sum(f"__v_{v}").over(bucket).alias(f"__t_{v}") for v in vnames])
    per_bucket = local.groupBy(*keys).agg(*[F.max(f"__t_{v}").alias(f"__s_{v}") for v in vnames])
    before = Window.partitionBy(*pcols).orderBy(*bnames).rowsBetween(Window.unboundedPreceding, -1)
    off_cols = [F.coalesce(F.sum(f"__s_{v}").over(before), F.lit(0)).alias(f"__o_{v}") for v in vnames]
    if totals:
        whole = Window.partitionBy(*pcols)
        off_cols += [F.sum(f"__s_{v}").over(whole).alias(f"total_{v}") for v in vnames]
    offsets = per_bucket.select(*keys, *off_cols)

    j = _null_safe_join(local, offsets, keys, bounded_buckets)
    out = j.select("*", *[(F.col(f"__o_{v}") + F.col(f"__l_{v}")).alias(v) for v in vnames])
    drop = bnames + [f"__{p}_{v}" for v in vnames for p in ("v", "o", "l", "t")]
    return out.drop(*drop)


def exact_row_number(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column],
                     bucket_by: Sequence[Column], *, name: str = "rn", total: str | None = None,
                     bounded_buckets: bool = False) -> DataFrame:
    """``row_number()`` (1-based) over (partition_by, order_by); ``order_by`` must be a total order."""
    out = running_totals(df, partition_by, order_by, bucket_by, {"__rn": F.lit(1).cast("long")},
                         totals=total is not None, bounded_buckets=bounded_buckets)
    out = out.withColumn(name, F.col("__rn") + F.lit(1)).drop("__rn")
    if total is not None:
        out = out.withColumnRenamed("total___rn", total)
    return out


def previous_value(df: DataFrame, partition_by: Sequence[str], order_col: str, value_col: str, *,
                   out: str, shift_bits: int = 12) -> DataFrame:
    """``lag(value_col) OVER (PARTITION BY p ORDER BY order_col)`` for a unique integer ``order_col``.

    A window over (p, order_col >> shift_bits) gives all but a bucket's first row its value, so a hot partition key
    spreads over many tasks. The last row of the bucket before is added to each bucket for its first row: which one that is
    follows from the narrow columns. The rows are shuffled once, with their value, and joined with nothing.
    """
    keys = list(partition_by)
    d = df.withColumn("__bucket", F.shiftright(F.col(order_col), shift_bits))
    ends = d.groupBy(*keys, "__bucket").agg(F.max(order_col).alias("__end"))
    before = F.lag("__end").over(Window.partitionBy(*keys).orderBy("__bucket"))
    ends = ends.select(*[F.col(k).alias(f"__p_{k}") for k in keys], F.col("__bucket").alias("__to"), before.alias("__before")).where("__before IS NOT NULL")
    if ends.count() <= BROADCAST_ENDS:
        ends = F.broadcast(ends)
    cond = d[order_col] == ends["__before"]
    for k in keys:
        cond = cond & d[k].eqNullSafe(ends[f"__p_{k}"])
    last = d.join(ends, cond).select(*keys, order_col, value_col, F.col("__to").alias("__bucket"), F.lit(True).alias("__added"))
    rows = d.withColumn("__added", F.lit(False)).unionByName(last, allowMissingColumns=True)
    own = Window.partitionBy(*keys, "__bucket").orderBy(order_col)
    return rows.withColumn(out, F.lag(value_col).over(own)).where("NOT __added").drop("__bucket", "__added")
