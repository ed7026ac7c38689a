"""File sources: comment CSVs, tab-separated files, capped corpus scans.

Schemas are explicit (never inferred: inference is an extra pass over the data). CSV text may hold
quotes and line breaks, hence ``multiLine`` with ``"`` as quote and escape; writes keep leading and
trailing blanks. Parquet is preferred for everything after ingestion.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from threadtox.operators.ranking import exact_row_number, running_totals

COMMENT_SCHEMA = StructType([
    StructField("id", LongType()), StructField("text", StringType()), StructField("parent", StringType()),
    StructField("label", IntegerType()), StructField("api", DoubleType())])

CSV_READ = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "FAILFAST"}
CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false"}


def read_comments_csv(spark: SparkSession, path: str, schema: StructType = COMMENT_SCHEMA) -> DataFrame:
    """Comment table from CSV (header row, quoted multi-line text; empty fields read as null)."""
    return spark.read.schema(schema).options(**CSV_READ).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**CSV_WRITE).csv(path)


ANNOTATION_SCHEMA = StructType([
    StructField("id", LongType()), StructField("tox_codes_oc", StringType()), StructField("text", StringType()),
    StructField("toxicity_annotator_count", IntegerType()), StructField("parent", StringType()), StructField("tox_codes_ic", StringType()),
    StructField("tox_codes_parent", StringType()), StructField("workers_ic", StringType())])
ANNOTATION_LISTS = {"tox_codes_oc": "string", "tox_codes_ic": "string", "tox_codes_parent": "string", "workers_ic": "bigint"}


def parse_list(text, kind: str = "string"):
    """A list as it stands in a CSV field, ``['A', 'B C']`` or ``[1, 2]``, with either quote: array of ``kind``; null stays null."""
    parts = F.regexp_extract_all(text, F.lit("'([^']*)'|\"([^\"]*)\"|([^\\s,\\[\\]'\"]+)"), F.lit(0))
    return F.transform(parts, lambda x: F.regexp_replace(x, "^['\"]|['\"]$", "").cast(kind))


def read_annotations_csv(spark: SparkSession, path: str) -> DataFrame:
    """The annotated corpus (eight columns) from CSV, its code and annotator lists as arrays."""
    rows = spark.read.schema(ANNOTATION_SCHEMA).options(**CSV_READ).csv(path)
    return rows.withColumns({c: parse_list(F.col(c), kind) for c, kind in ANNOTATION_LISTS.items()})


def write_annotations_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    def written(c: str, kind: str):
        cells = F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))) if kind == "string" else F.transform(c, lambda x: x.cast("string"))
        return F.when(F.col(c).isNotNull(), F.concat(F.lit("["), F.array_join(cells, ", "), F.lit("]")))
    write_csv(df.select(*(written(f.name, ANNOTATION_LISTS[f.name]).alias(f.name) if f.name in ANNOTATION_LISTS else f.name for f in ANNOTATION_SCHEMA)), path, mode)


def read_tsv(spark: SparkSession, path: str, quote: str | None = None) -> DataFrame:
    """Every line of tab-separated files as ``fields`` (array<string>): all fields of all lines, however many a
    line has; an empty field is '', an empty line one empty field. The first line is data (no header handling).

    ``quote=None`` leaves quote characters in the values. With a quote character, a field that begins with it runs to
    the quote that stands before a tab or the line's end; a doubled quote inside stands for one. A quoted field
    cannot hold a line break (each line is read on its own, so any file splits into tasks).
    """
    lines = spark.read.text(path)
    if quote is None:
        return lines.select(F.split("value", "\t", -1).alias("fields"))
    q = re.escape(quote)
    # a tab is put at the end so that every field, the last one too, ends with one
    parts = F.regexp_extract_all(F.concat("value", F.lit("\t")), F.lit(f"(?:{q}(?:[^{q}]|{q}{q})*{q}|[^\t]*)\t"), F.lit(0))
    bare = F.transform(parts, lambda x: F.substring(x, F.lit(1), F.length(x) - 1))
    fields = F.transform(bare, lambda x: F.when(
        x.rlike(f"(?s)^{q}.*{q}$") & (F.length(x) > 1),
        F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit(quote * 2), F.lit(quote))).otherwise(x))
    return lines.select(fields.alias("fields"))


def write_tsv(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", "\t").option("quote", "").option("header", str(header).lower()).csv(path)


def capped_scan(df: DataFrame, n: int, order: str = "id", bucket_bits: int = 16,
                max_broadcast: int = 1_000_000) -> DataFrame:
    """The first ``n`` rows in ``order`` (a unique integer column), exactly.

    Buckets of ``order >> bucket_bits`` are counted first, and each bucket's start row comes from the
    two-level running total (so the bucket table, which grows with the id range, is never ordered in one
    task). Only buckets that start before row ``n`` can hold a kept row, and there are at most ``n`` of
    them (each holds a row): that list prunes the scan before anything wide is shuffled — broadcast when
    ``n <= max_broadcast``, otherwise joined as AQE sees fit. The survivors are ranked exactly.
    """
    bucket = F.shiftright(F.col(order), bucket_bits)
    counts = df.groupBy(bucket.alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    starts = running_totals(counts, [], [F.col("__b")], [F.shiftright(F.col("__b"), 12)], {"__start": F.col("__c")})
    keep = starts.where(F.col("__start") < F.lit(n)).select("__b")
    if n <= max_broadcast:
        keep = F.broadcast(keep)
    pruned = df.withColumn("__b", bucket).join(keep, "__b", "left_semi").drop("__b")
    ranked = exact_row_number(pruned, [], [F.col(order)], [F.shiftright(F.col(order), bucket_bits)], name="__rn")
    return ranked.where(F.col("__rn") <= F.lit(n)).drop("__rn")
