"""Annotator codes: consolidation, exclusion of unsure posts, toxic-vote rates, context sensitivity.

Codes are arrays per post (one entry per annotator); everything is an array expression on the row — no
explode, no shuffle — except the per-condition reshaping, which is a two-element ``explode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------------
TOXIC_CODES = ["TOXIC", "VERY TOXIC"]   # unified into one toxic class
UNSURE = "UNSURE"
CONDITIONS = {"oc": "tox_codes_oc", "ic": "tox_codes_ic"}
# -------------------------------------------------------------------------------------------------


def unify(codes: Column) -> Column:
    """TOXIC and VERY TOXIC become TOXIC; other codes unchanged."""
    return F.transform(codes, lambda c: F.when(c.isin(*TOXIC_CODES), F.lit("TOXIC")).otherwise(c))


def drop_unsure(df: DataFrame, columns=tuple(CONDITIONS.values())) -> DataFrame:
    """Posts where no annotator (in any listed condition) answered UNSURE."""
    cond = None
    for c in columns:
        e = ~F.coalesce(F.array_contains(F.col(c), F.lit(UNSURE)), F.lit(False))
        cond = e if cond is None else cond & e
    return df.where(cond)


def toxic_votes(codes: Column) -> Column:
    return F.size(F.filter(codes, lambda c: c.isin(*TOXIC_CODES)))


def toxic_rate(codes: Column) -> Column:
    """Toxic share of the votes; null without votes (a null or empty list)."""
    return F.try_divide(toxic_votes(codes).cast("double"), F.size(codes).cast("double"))


def annotator_rate(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per (post, condition): n_votes, n_toxic, rate (toxic share of the votes)."""
    per = F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), F.col(c).alias("codes"))
                              for k, c in CONDITIONS.items()])).alias("__c")
    r = df.select(F.col(key), per).select(key, "__c.condition", "__c.codes")
    return r.select(key, "condition", F.size("codes").cast("long").alias("n_votes"),
                    toxic_votes(F.col("codes")).cast("long").alias("n_toxic"),
                    toxic_rate(F.col("codes")).alias("rate"))


def context_sensitivity(df: DataFrame, threshold: float = 0.3, key: str = "id") -> DataFrame:
    """Per post: toxic rate without (oc) and with (ic) context, delta = ic - oc, and whether |delta| reaches
    ``threshold`` (the post's perceived toxicity depends on its parent); null where a condition has no votes."""
    out = df.select(F.col(key), toxic_rate(F.col(CONDITIONS["oc"])).alias("rate_oc"), toxic_rate(F.col(CONDITIONS["ic"])).alias("rate_ic"))
    out = out.withColumn("delta", F.col("rate_ic") - F.col("rate_oc"))
    # rates are ratios of small integers: compare with a tolerance so 0.7 - 0.4 counts as 0.3
    return out.withColumn("sensitive", F.abs(F.col("delta")) >= F.lit(threshold - 1e-9))


def annotator_votes(df: DataFrame, workers: str = "workers_ic", codes: str = "tox_codes_ic", key: str = "id") -> DataFrame:
    """One row per annotator: n_posts, n_toxic, rate, and agreement, the share of votes that fall with the post's majority
    (a tie is no majority: such votes are left out, and without others the agreement is null). Votes are paired with
    annotators by place; a list that is longer than the other ends with the shorter, a null list has none. Posts are rows."""
    vote = F.col("__v")
    n = F.least(F.size(workers), F.size(codes))
    votes = df.where(F.col(workers).isNotNull() & F.col(codes).isNotNull()).withColumn("__rate", toxic_rate(F.slice(codes, F.lit(1), n))) \
        .select("__rate", F.explode(F.arrays_zip(F.slice(workers, F.lit(1), n).alias("worker"), F.slice(codes, F.lit(1), n).alias("code"))).alias("__v")) \
        .select(vote["worker"].alias("worker"), vote["code"].isin(*TOXIC_CODES).alias("toxic"), "__rate").where("worker IS NOT NULL")
    decided = F.col("__rate") != 0.5
    agrees = F.when(decided, F.when(F.col("toxic") == (F.col("__rate") > 0.5), 1.0).otherwise(0.0))
    return votes.groupBy("worker").agg(F.count("*").alias("n_posts"), F.sum(F.col("toxic").cast("long")).alias("n_toxic"),
                                       F.avg(F.col("toxic").cast("double")).alias("rate"), F.avg(agrees).alias("agreement"))


def parent_effect(df: DataFrame, threshold: float = 0.3, parent: str = "tox_codes_parent", key: str = "id") -> DataFrame:
    """The context effect beside the parent's own toxicity: posts with a toxic parent (half of its votes or more), with
    another parent, and without votes on the parent: n, mean rates without and with context, mean difference, and how many
    are context-sensitive."""
    rate = toxic_rate(F.col(parent))
    of = F.when(rate >= 0.5, "toxic").when(rate.isNotNull(), "other").otherwise("none")
    both = context_sensitivity(df.withColumn("__key", F.struct(F.col(key), of.alias("parent"))), threshold, "__key")
    return both.groupBy(F.col("__key.parent").alias("parent")).agg(
        F.count("*").alias("n"), F.avg("rate_oc").alias("rate_oc"), F.avg("rate_ic").alias("rate_ic"), F.avg("delta").alias("delta"),
        F.sum(F.col("sensitive").cast("long")).alias("n_sensitive"))
