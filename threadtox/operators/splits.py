"""Repeated random splits, hold-out splits, balanced downsampling and split selection.

Every random order is an md5 of (seed + split, id): stable across runs, partitionings and engines, and
independent of row order. The same id lands in the same part in every setting (gc, gn) of a split.

Exact part sizes need only the keys at which the parts are cut (two per setting and split), not ranks of all
rows. :func:`cut_keys` finds them from narrow rows: hash prefixes are counted map-side, the prefix that holds a cut
is ranked alone, and the cut keys (one small table) label the rows in place. No row is shuffled, whatever
columns it carries.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadtox.functions.hashing import sort_key
from threadtox.session import materialize

PARTS = ("train", "dev", "val")
BUCKET_ROWS = 1 << 18        # target rows per (key, hash-prefix) ranking task
BROADCAST_CUTS = 1 << 18     # largest cut table (about 100 bytes a row) that is broadcast


def prefix_digits_for(rows_per_key: int, target: int = BUCKET_ROWS, minimum: int = 3) -> int:
    """Hex digits of hash prefix so that one (key, prefix) bucket holds about ``target`` rows: md5 hex is
    uniform, so each extra digit divides the bucket by 16."""
    if rows_per_key <= target:
        return minimum
    return max(minimum, math.ceil(math.log(rows_per_key / target, 16)))


def _same(left: DataFrame, right: DataFrame, by: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in by:
        cond = cond & left[k].eqNullSafe(right[f"__{k}"])
    return cond


def cut_keys(df: DataFrame, by: Sequence[str], key: Column, targets: Mapping[str, Column],
             prefix_digits: int | None = None) -> DataFrame:
    """(by..., one struct(key, id) per target): in the order of (``key``, id) within ``by``, the last of the first
    ``target`` rows; null where the target is below 1. ``targets`` are expressions of ``n``, the rows of the group.

    Reads the narrow columns only: one aggregate over hash prefixes, one filtered pass for the prefixes that hold
    a cut (about ``BUCKET_ROWS`` rows each). Ids must be unique within ``by``.
    """
    by = list(by)
    if prefix_digits is None:
        prefix_digits = prefix_digits_for(df.count())
    rows = df.select(*by, "id", key.alias("key")).withColumn("prefix", F.substring("key", 1, prefix_digits))
    counts = materialize(rows.groupBy(*by, "prefix").agg(F.count(F.lit(1)).alias("c")), "prefixes")
    order = Window.partitionBy(*by).orderBy("prefix")
    seen = counts.withColumn("before", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    cuts = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.least(t.cast("long"), F.col("n")).alias("at")) for name, t in targets.items()]))
    wanted = seen.withColumn("cut", cuts).filter((F.col("cut.at") > F.col("before")) & (F.col("cut.at") <= F.col("before") + F.col("c"))) \
        .select(*[F.col(k).alias(f"__{k}") for k in by], F.col("prefix").alias("__prefix"), F.col("cut.name").alias("name"),
                (F.col("cut.at") - F.col("before")).alias("need"))
    wanted = materialize(wanted, "cuts")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_CUTS else wanted
    inside = rows.join(few, _same(rows, few, by) & (rows["prefix"] == few["__prefix"])).select(*by, "name", "need", "key", "id")
    rank = F.row_number().over(Window.partitionBy(*by, "name").orderBy("key", "id"))
    found = inside.withColumn("rank", rank).filter(F.col("rank") == F.col("need"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.struct("key", "id"))).alias(name) for name in targets])


def _label(df: DataFrame, by: Sequence[str], key: Column, targets: Mapping[str, Column], prefix_digits: int | None) -> DataFrame:
    """``df`` with a column ``__<target>`` per target: whether the row is among the first ones up to the cut."""
    cuts = materialize(cut_keys(df, by, key, targets, prefix_digits), "cut-keys")
    renamed = cuts.select(*[F.col(k).alias(f"__{k}") for k in by], *[F.col(t).alias(f"__cut_{t}") for t in targets])
    if cuts.count() <= BROADCAST_CUTS:
        renamed = F.broadcast(renamed)
    own = F.struct(key.alias("key"), F.col("id").alias("id"))
    joined = df.withColumn("__own", own).join(renamed, _same(df, renamed, by), "left")
    flags = {f"__{t}": F.coalesce(F.col("__own") <= F.col(f"__cut_{t}"), F.lit(False)) for t in targets}
    return joined.withColumns(flags).drop("__own", *[f"__{k}" for k in by], *[f"__cut_{t}" for t in targets])


def mccv_split(df: DataFrame, splits: int = 10, seed: int = 42, test_size: float = 0.2,
               by: Sequence[str] = ("setting",), prefix_digits: int | None = None) -> DataFrame:
    """Monte-Carlo cross-validation: ``splits`` independent shuffles, each cut into exact parts.

    val = ceil(test_size * n) rows, dev = the same count (as the study draws it), train = the rest.
    Adds ``split`` and ``part`` (and keeps every input column, without shuffling it).
    """
    by = [b for b in by if b in df.columns] + ["split"]
    if prefix_digits is None:
        prefix_digits = prefix_digits_for(df.count())  # rows per (by, split): at most the input rows
    e = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    key = sort_key(F.col("split") + F.lit(seed), F.col("id"))
    n_val = F.ceil(F.col("n").cast("double") * F.lit(float(test_size))).cast("long")
    r = _label(e, by, key, {"val": n_val, "dev": F.lit(2) * n_val}, prefix_digits)
    part = F.when(F.col("__val"), F.lit("val")).when(F.col("__dev"), F.lit("dev")).otherwise(F.lit("train"))
    return r.withColumn("part", part).drop("__val", "__dev")


def holdout_split(df: DataFrame, test_size: float = 0.1, seed: int = 42,
                  prefix_digits: int | None = None) -> DataFrame:
    """Two-way split: ceil(test_size * n) rows go to ``dev``, the rest to ``train``."""
    n_dev = F.ceil(F.col("n").cast("double") * F.lit(float(test_size))).cast("long")
    r = _label(df, [], sort_key(F.lit(seed), F.col("id")), {"first": n_dev}, prefix_digits)
    return r.withColumn("part", F.when(F.col("__first"), F.lit("dev")).otherwise(F.lit("train"))).drop("__first")


def balanced_downsample(df: DataFrame, label: str = "label", seed: int = 42, by: Sequence[str] = (),
                        prefix_digits: int | None = None) -> DataFrame:
    """Keep, per class, the first m rows in hash order, where m = size of the smallest class.

    With ``by`` (e.g. setting) the minimum is taken over every (by, class) group, so all settings end
    up with the same size (equibalanced and equally sized).
    """
    parts = [*by, label]
    m = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0  # one number
    r = _label(df, parts, sort_key(F.lit(seed), F.lit("balance"), F.col("id")), {"first": F.lit(m)}, prefix_digits)
    return r.where("__first").drop("__first")


def scan_split(split_table: DataFrame, split: int, setting: str = "gc") -> DataFrame:
    """The rows one experiment reads: train/dev of ``setting``, val always from ``gc``."""
    return split_table.where((F.col("split") == F.lit(split))
                             & (((F.col("setting") == F.lit(setting)) & F.col("part").isin("train", "dev"))
                                | ((F.col("setting") == F.lit("gc")) & (F.col("part") == F.lit("val")))))


def pooled_eval_set(split_table: DataFrame, splits: int, setting: str = "gc") -> DataFrame:
    """Union of the val parts of the first ``splits`` splits, one row per id (the earliest split wins)."""
    v = split_table.where((F.col("setting") == F.lit(setting)) & (F.col("part") == F.lit("val"))
                          & (F.col("split") < F.lit(splits)))
    # the first split per id by aggregation (map-side partial), then a semi-join back: no window needed.
    first = v.groupBy("id").agg(F.min("split").alias("__first"))
    return v.join(first, (v["id"] == first["id"]) & (v["split"] == first["__first"]), "left_semi")
