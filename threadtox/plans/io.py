"""Registered queries: file sources and sinks as write-then-read round trips through the shared folder
(S1 CSV form, S4/X4, S6, K1-K3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadtox.plans.evaluation import gc_val, q_predictions_wide, split_table, with_splits
from threadtox.plans.features import _pair_sql, q_pair_features
from threadtox.plans.registry import register
from threadtox.plans.sql import SPLITS
from threadtox.session import scratch_path
from threadtox.sources import fixtures as fx
from threadtox.sources import files, sinks, zipped

CAP = 100_000   # rows of the transfer corpus the study reads
CUT = 137       # a cap below every table here, so that it cuts


@register("scan_csv_comments", "S1", fx.with_fixtures("SELECT id, text, parent, label, api FROM gc"))
def q_scan_csv_comments(spark, d):
    path = scratch_path(spark, "comments-csv")
    files.write_csv(fx.comments(spark, d), path)
    return files.read_comments_csv(spark, path)


@register("scan_tsv", "S6", """
    WITH lines AS (SELECT unnest(string_split(replace(replace(l, chr(13), ' '), ' ', chr(9)), chr(10))) AS line FROM (
      SELECT CASE WHEN doc_id % 4 = 0 THEN coalesce(text, '')
                  WHEN doc_id % 4 = 1 THEN concat(doc_id, ' ', coalesce(lang, ''), '  "', coalesce(source, ''), '"')
                  WHEN doc_id % 4 = 2 THEN ''
                  ELSE concat(' ', n_chars, ' x ', coalesce(source, ''), ' ') END AS l FROM documents))
    SELECT string_split(line, chr(9)) AS fields FROM lines""")
def q_scan_tsv(spark, d):
    """Ragged lines: whole texts cut into fields at their blanks and into lines at their breaks, empty lines, empty
    fields at either end, quote characters."""
    line = F.when(F.col("doc_id") % 4 == 0, F.coalesce("text", F.lit(""))) \
        .when(F.col("doc_id") % 4 == 1, F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("lang", F.lit("")), F.lit('  "'),
                                                 F.coalesce("source", F.lit("")), F.lit('"'))) \
        .when(F.col("doc_id") % 4 == 2, F.lit("")) \
        .otherwise(F.concat(F.lit(" "), F.col("n_chars").cast("string"), F.lit(" x "), F.coalesce("source", F.lit("")), F.lit(" ")))
    path = scratch_path(spark, "documents-tsv")
    fx.table(spark, d, "documents").select(F.regexp_replace(line, "[\\r ]", "\t").alias("value")).write.text(path)
    return files.read_tsv(spark, path)


@register("scan_capped", "S4 X4 P1", fx.with_fixtures(
    f"SELECT id, comment_text AS text, target FROM cctk ORDER BY id LIMIT {CAP}", "cctk"))
def q_scan_capped(spark, d):
    c = files.capped_scan(fx.cctk(spark, d), CAP)
    return c.select("id", F.col("comment_text").alias("text"), "target")


def archived(corpus, mb: float = 64):
    """The corpus in partitions of about ``mb`` megabytes of text, two at least: an archive is read by one task."""
    size = corpus.agg(F.sum(F.octet_length("comment_text"))).first()[0] or 0
    return corpus.repartition(max(2, -(-size // int(mb * 1e6))), "id")


@register("scan_zip", "S4 X4", fx.with_fixtures(
    f"SELECT id, nullif(comment_text, '') AS text, target FROM cctk ORDER BY id LIMIT {CUT}", "cctk"))
def q_scan_zip(spark, d):
    """The capped scan of a corpus that lies in zip archives."""
    path = scratch_path(spark, "corpus-zip")
    zipped.write_zip_csv(archived(fx.cctk(spark, d)), path)
    corpus = zipped.read_zip_csv(spark, path, "id long, comment_text string, target double")
    return files.capped_scan(corpus, CUT, bucket_bits=6).select("id", F.col("comment_text").alias("text"), "target")


@register("scan_capped_cut", "S4 X4", fx.with_fixtures(
    f"SELECT id, comment_text AS text, target FROM cctk ORDER BY id LIMIT {CUT}", "cctk"))
def q_scan_capped_cut(spark, d):
    c = files.capped_scan(fx.cctk(spark, d), CUT, bucket_bits=6)
    return c.select("id", F.col("comment_text").alias("text"), "target")


@register("sink_splits", "K1", with_splits("SELECT setting, split, part, id, label FROM split_table"))
def q_sink_splits(spark, d):
    path = scratch_path(spark, "splits")
    sinks.write_splits(split_table(spark, d).select("setting", "split", "part", "id", "label"), path)
    return spark.read.parquet(path).select("setting", "split", "part", "id", "label")


@register("sink_predictions", "K2", with_splits(
    """SELECT 'r0' AS run, 'api' AS model, split, id, label, api AS score
       FROM split_table WHERE setting = 'gc' AND part = 'val'"""))
def q_sink_predictions(spark, d):
    path = scratch_path(spark, "predictions")
    pred = gc_val(spark, d).select(F.lit("api").alias("model"), "split", "id", "label", F.col("api").alias("score"))
    sinks.write_predictions(pred, path, run="r0")
    return spark.read.parquet(path).select("run", "model", "split", "id", "label", "score")


_WIDE = ", ".join(f"max(CASE WHEN split = {i} THEN api END) AS {{p}}{i}" for i in range(SPLITS))


def _wide(spark, d, prefix: str):
    path = scratch_path(spark, "predictions-wide")
    sinks.write_predictions_wide(q_predictions_wide(spark, d), path, prefix)
    return spark.read.parquet(path)


@register("sink_predictions_wide", "K2 U3", with_splits(
    f"SELECT id, {_WIDE.format(p='split')} FROM split_table WHERE setting = 'gc' AND part = 'val' GROUP BY id"))
def q_sink_predictions_wide(spark, d):
    return _wide(spark, d, "split")


@register("sink_predictions_transfer", "K2 U3 M5", with_splits(
    f"SELECT id, {_WIDE.format(p='MCCV_')} FROM split_table WHERE setting = 'gc' AND part = 'val' GROUP BY id"))
def q_sink_predictions_transfer(spark, d):
    return _wide(spark, d, "MCCV_")


@register("sink_gold_pred", "K2", with_splits(
    "SELECT split, label AS gold, api AS pred FROM split_table WHERE setting = 'gc' AND part = 'val'"))
def q_sink_gold_pred(spark, d):
    path = scratch_path(spark, "gold-pred")
    sinks.write_gold_pred(gc_val(spark, d).select("split", "label", F.col("api").alias("score")), path)
    return spark.read.parquet(path).select("split", "gold", "pred")


def _features_sql() -> str:
    body = _pair_sql()
    head, tail = body.rsplit("SELECT q.id,", 1)
    inner = "SELECT q.id," + tail
    return (f"{head} SELECT id, input_ids, input_mask, segment_ids, [CAST(label_id AS BIGINT)] AS label_ids, "
            f"[CAST(1 AS BIGINT)] AS is_real_example FROM ({inner})")


@register("sink_features", "K3", fx.with_fixtures(_features_sql(), "pair_vocab"))
def q_sink_features(spark, d):
    path = scratch_path(spark, "features")
    sinks.write_features(q_pair_features(spark, d), path)
    return spark.read.parquet(path)
