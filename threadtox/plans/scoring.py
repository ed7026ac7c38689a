"""Registered queries: external batch scoring with a pluggable scorer (E1, E2, P8).

The scorer here is the deterministic stub (no network): u(capped text), failing for ~10% of texts
without a language hint and ~2% even with it, so both passes and all three statuses are exercised.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threadtox.functions.hashing import duckdb_uniform as U
from threadtox.operators.context import context_concat
from threadtox.operators.scoring import MAX_CHARS, external_score, ledger_score
from threadtox.plans.evaluation import split_text, with_splits
from threadtox.plans.registry import register
from threadtox.session import scratch_path
from threadtox.sources import fixtures as fx


def _stub_sql(text_expr: str, source: str = "gc") -> str:
    capped = f"substr({text_expr}, 1, {MAX_CHARS})"
    return f"""SELECT id,
        CASE WHEN t IS NULL OR uf < 0.02::DOUBLE THEN -1.0::DOUBLE ELSE round(u, 9) END AS score,
        CASE WHEN t IS NULL OR uf < 0.02::DOUBLE THEN 'failed' WHEN uf < 0.1::DOUBLE THEN 'retried' ELSE 'ok' END AS status
      FROM (SELECT id, {text_expr} AS t, {U(f"concat('f', {capped})")} AS uf, {U(capped)} AS u FROM {source})"""


def _rounded(df):
    return df.select("id", F.round(F.col("score"), 9).alias("score"), "status")


@register("external_score", "E1 P5 P8", fx.with_fixtures(_stub_sql("text")))
def q_external_score(spark, d):
    return _rounded(external_score(fx.comments(spark, d), "text"))


@register("external_score_context", "E2 P2", fx.with_fixtures(_stub_sql("parent || text")))
def q_external_score_context(spark, d):
    c = fx.comments(spark, d)
    return _rounded(external_score(c, context_concat(F.col("parent"), F.col("text"))))


SCORED_SPLIT = 2


def score_split(spark, d, split: int, context: bool, part: str = "val"):
    """Scores of one repetition's part, of the text alone or after its parent."""
    c = split_text(spark, d, split, "gc", part)
    return external_score(c, context_concat(F.col("parent"), F.col("text")) if context else F.col("text"))


_SCORED = f"(SELECT * FROM split_table WHERE setting = 'gc' AND part = 'val' AND split = {SCORED_SPLIT})"


@register("external_score_split", "E2 P2", with_splits(_stub_sql("parent || text", _SCORED)))
def q_external_score_split(spark, d):
    return _rounded(score_split(spark, d, SCORED_SPLIT, context=True))


@register("external_score_ledger", "E1 P5 P8", fx.with_fixtures(_stub_sql("text")))
def q_external_score_ledger(spark, d):
    """An earlier run answered one label's comments; the next run asks for the rest and reads the ledger for all."""
    c, ledger = fx.comments(spark, d), scratch_path(spark, "ledger")
    ledger_score(c.where("label = 1"), ledger)
    return _rounded(ledger_score(c, ledger, concurrency=4))
