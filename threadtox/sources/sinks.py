"""Sinks: the split table, long prediction tables and encoder feature records, all partitioned parquet.

Writers refuse an existing target by default (``errorifexists``), like the study's split writer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLIT_PARTITIONS = ("split", "setting", "part")


ROWS_PER_FILE = 4_000_000


def by_split(split_table: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Rows brought together by split / setting / part before they are written, each folder's rows in as many tasks
    as they need files: tasks x folders small files are avoided, and a large part is not one task."""
    folders = split_table.groupBy(*SPLIT_PARTITIONS).count().agg(F.max("count")).first()[0] or 0
    salt = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-folders // rows_per_file))))
    return split_table.repartition(*SPLIT_PARTITIONS, salt)


def write_splits(split_table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One directory level per split / setting / part, so readers prune to the files they need."""
    by_split(split_table).write.mode(mode).partitionBy(*SPLIT_PARTITIONS).parquet(path)


def write_predictions(pred: DataFrame, path: str, run: str, mode: str = "errorifexists") -> None:
    """Long predictions (model, split, id, label, score), one partition per run."""
    pred.withColumn("run", F.lit(run)).write.mode(mode).partitionBy("run").parquet(path)


def write_predictions_wide(wide: DataFrame, path: str, prefix: str = "split", mode: str = "errorifexists") -> None:
    """Wide predictions: one row per id, one column per repetition (``split0`` .., or ``MCCV_0`` .. for a transfer run)."""
    renamed = {c: prefix + c.removeprefix("split") for c in wide.columns if c.startswith("split")}
    wide.withColumnsRenamed(renamed).write.mode(mode).parquet(path)


def write_gold_pred(pred: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(gold, pred) pairs of a run, one row per scored comment, a folder per repetition."""
    pred.select("split", F.col("label").alias("gold"), F.col("score").alias("pred")) \
        .write.mode(mode).partitionBy("split").parquet(path)


def feature_records(features: DataFrame) -> DataFrame:
    """Encoder features as int64 lists: input_ids, input_mask, segment_ids, label_ids (one element),
    is_real_example (one element, 1 for real rows)."""
    return features.select(
        "id",
        F.col("input_ids").cast("array<bigint>").alias("input_ids"),
        F.col("input_mask").cast("array<bigint>").alias("input_mask"),
        F.col("segment_ids").cast("array<bigint>").alias("segment_ids"),
        F.array(F.col("label_id").cast("bigint")).alias("label_ids"),
        F.array(F.col("is_real_example").cast("bigint")).alias("is_real_example"))


def write_features(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    feature_records(features).write.mode(mode).parquet(path)
