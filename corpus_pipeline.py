"""A corpus pipeline: five of the text operators, one after another, over ``documents``.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadtox.llm import decontam, dedup, line_quality, line_templates, mixing
from threadtox.llm.rows import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return line_quality.keep_good(docs, table(spark, sf_dir, "labels"), min_words=50, max_repeat=50)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; so do documents of which nothing is left then."""
    left = line_templates.drop_templates(docs, depth=3, min_docs=5, min_share=80, lead_share=70, long_docs=2, long_tokens=50)
    if "n_chars" in left.columns:
        left = left.withColumn("n_chars", F.length("text").cast(left.schema["n_chars"].dataType))
    return left.filter(F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; the similarity of a link is 0.8 or more."""
    return dedup.keep_one_of_each(docs, percent=80, match=24)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the mixture, with their pass and place."""
    return mixing.mix(docs, target_entropy=0.98, max_repeat=2.0, seed=1, block_docs=1000)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("decontamination", decontamination), ("source mixing", source_mixing)]

#: The first stage's model has no SQL form; a test holds run()'s rows to the operators' brute-force versions, chained.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
