"""Registered queries: comment sources, splits and the evaluation layer (S1-S2, X1-X3, X6, U1-U3, A1-A4,
A7-A12, J1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadtox.operators import metrics as M
from threadtox.operators import splits as S
from threadtox.operators.scoring import join_scores
from threadtox.operators.text import fits_broadcast
from threadtox.plans.registry import register
from threadtox.plans.sql import SEED, SPLITS, TEST_SIZE, auroc_sql, split_table_sql
from threadtox.session import materialized_once
from threadtox.sources import fixtures as fx
from threadtox.sources.sinks import SPLIT_PARTITIONS, by_split

R9 = 9          # doubles are compared rounded to 9 decimals in both engines
POOLED = 5      # evaluation sets pooled by the significance test
REPLICATES = 200
WITH_TEXT_MB = 150   # split rows that are broadcast to the texts


def r9(c):
    return F.round(c, R9)


def split_table(spark: SparkSession, d: str) -> DataFrame:
    """The MCCV split table of both settings, without texts: id, label, api by split / setting / part (written once per
    session, like the study's split files, in a folder for each part)."""
    def build():
        rows = fx.comment_settings(spark, d).select("id", "setting", "label", "api")
        return by_split(S.mccv_split(rows, splits=SPLITS, seed=SEED, test_size=TEST_SIZE))
    return materialized_once(spark, ("split_table", d), build, SPLIT_PARTITIONS)


def with_text(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """The texts of the split rows that are read (both settings annotate the same comments). The split rows are narrow: those
    that fit (counted first) go to the texts, and no text moves."""
    rows = rows.select("id", "split", "setting", "part", "label", "api")
    if fits_broadcast(rows.count(), 100, WITH_TEXT_MB):
        rows = F.broadcast(rows)
    return rows.join(fx.comments(spark, d).select("id", "text", "parent"), "id")


def split_text(spark: SparkSession, d: str, split: int, setting: str, part: str) -> DataFrame:
    t = split_table(spark, d)
    return with_text(spark, d, t.where((F.col("split") == split) & (F.col("setting") == setting) & (F.col("part") == part)))


def gc_val(spark: SparkSession, d: str) -> DataFrame:
    st = split_table(spark, d)
    return st.where((F.col("setting") == "gc") & (F.col("part") == "val"))


SPLIT_CTES = ("settings",)


def with_splits(sql: str) -> str:
    body = sql.strip()
    body = body[5:] if body.upper().startswith("WITH ") else body
    joiner = ",\n" if sql.strip().upper().startswith("WITH ") else "\n"
    return fx.with_fixtures(f"WITH split_table AS ({split_table_sql()}){joiner}{body}", *SPLIT_CTES)


# ---- S1 / X1 / S2 ---------------------------------------------------------------------------------

@register("scan_comments", "S1", fx.with_fixtures(
    "SELECT id, setting, text, parent, label, api FROM settings", "settings"))
def q_scan_comments(spark, d):
    return fx.comment_settings(spark, d).select("id", "setting", "text", "parent", "label", "api")


@register("mccv_split", "X1 J4", with_splits(
    "SELECT setting, split, part, id, label FROM split_table"))
def q_mccv_split(spark, d):
    return split_table(spark, d).select("setting", "split", "part", "id", "label")


@register("scan_split", "S2 X6", with_splits(
    """SELECT setting, split, part, id, label FROM split_table
       WHERE split = 3 AND ((setting = 'gn' AND part IN ('train', 'dev')) OR (setting = 'gc' AND part = 'val'))"""))
def q_scan_split(spark, d):
    return S.scan_split(split_table(spark, d), split=3, setting="gn").select("setting", "split", "part", "id", "label")


@register("holdout_split", "X2", fx.with_fixtures(
    f"""SELECT id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', {SEED}, id)), id) - 1
                      < CAST(ceil(count(*) OVER () * 0.1::DOUBLE) AS BIGINT) THEN 'dev' ELSE 'train' END AS part,
               CAST(CASE WHEN target = 0.5 THEN 0 ELSE round(target) END AS INTEGER) AS label
        FROM cctk""", "cctk"))
def q_holdout_split(spark, d):
    from threadtox.operators.features import binarize
    c = fx.cctk(spark, d).withColumn("label", binarize(F.col("target")))
    return S.holdout_split(c, test_size=0.1, seed=SEED).select("id", "part", "label")


@register("balanced_downsample", "X3", fx.with_fixtures(
    f"""SELECT setting, id, label FROM (
          SELECT *, row_number() OVER (PARTITION BY setting, label ORDER BY md5(concat_ws(':', {SEED}, 'balance', id)), id) AS rn,
                 min(n) OVER () AS m
          FROM (SELECT *, count(*) OVER (PARTITION BY setting, label) AS n FROM settings) x) y
        WHERE rn <= m""", "settings"))
def q_balanced_downsample(spark, d):
    b = S.balanced_downsample(fx.comment_settings(spark, d), seed=SEED, by=["setting"])
    return b.select("setting", "id", "label")


@register("balanced_splits", "X3 X1", fx.with_fixtures(
    f"""WITH balanced AS (SELECT * EXCLUDE (rn, m, n) FROM (
          SELECT *, row_number() OVER (PARTITION BY setting, label ORDER BY md5(concat_ws(':', {SEED}, 'balance', id)), id) AS rn,
                 min(n) OVER () AS m
          FROM (SELECT *, count(*) OVER (PARTITION BY setting, label) AS n FROM settings) x) y WHERE rn <= m),
        split_table AS ({split_table_sql('balanced')})
        SELECT setting, split, part, id, label FROM split_table""", "settings"))
def q_balanced_splits(spark, d):
    """The study's balanced experiment: splits drawn over the downsampled set."""
    b = S.balanced_downsample(fx.comment_settings(spark, d).select("id", "setting", "label"), seed=SEED, by=["setting"])
    return S.mccv_split(b, splits=SPLITS, seed=SEED, test_size=TEST_SIZE).select("setting", "split", "part", "id", "label")


@register("pooled_eval_set", "U1 U2 W2", with_splits(
    f"""SELECT id, split, label, api FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY split) AS rn FROM split_table
          WHERE setting = 'gc' AND part = 'val' AND split < {POOLED}) WHERE rn = 1"""))
def q_pooled_eval_set(spark, d):
    return S.pooled_eval_set(split_table(spark, d), POOLED).select("id", "split", "label", "api")


# ---- A1 / A2 / A3 ---------------------------------------------------------------------------------

@register("auroc", "A1", fx.with_fixtures(
    f"SELECT n_pos, n_neg, round(auroc, {R9}) AS auroc FROM ({auroc_sql('gc', [], 'api')})"))
def q_auroc(spark, d):
    a = M.auroc(fx.comments(spark, d), [], score="api")
    return a.select("n_pos", "n_neg", r9(F.col("auroc")).alias("auroc"))


_VAL = "(SELECT * FROM split_table WHERE setting = 'gc' AND part = 'val')"


@register("auroc_by_split", "A2", with_splits(
    f"SELECT split, n_pos, n_neg, round(auroc, {R9}) AS auroc FROM ({auroc_sql(_VAL, ['split'], 'api')})"))
def q_auroc_by_split(spark, d):
    a = M.auroc(gc_val(spark, d), ["split"], score="api", n_keys=SPLITS)
    return a.select("split", "n_pos", "n_neg", r9(F.col("auroc")).alias("auroc"))


def mccv_summary_frame(spark, d) -> DataFrame:
    per = M.auroc(gc_val(spark, d), ["split"], score="api", n_keys=SPLITS)
    s = M.mccv_summary(per)
    return s.select(F.col("n_splits").cast("long").alias("n_splits"), r9(F.col("mean")).alias("mean_auroc"),
                    r9(F.col("sem")).alias("sem_auroc"))


@register("mccv_summary", "A3", with_splits(
    f"""SELECT CAST(count(auroc) AS BIGINT) AS n_splits, round(avg(auroc), {R9}) AS mean_auroc,
              round(stddev_samp(auroc) / sqrt(count(auroc)), {R9}) AS sem_auroc
       FROM ({auroc_sql(_VAL, ['split'], 'api')})"""))
def q_mccv_summary(spark, d):
    return mccv_summary_frame(spark, d)


# ---- A4 / A7 / A8 / A9 / A10 / A12 --------------------------------------------------------------

_TRAIN = "(SELECT * FROM split_table WHERE part = 'train')"


@register("class_prior", "A4 F14", with_splits(
    f"""SELECT setting, split, CAST(SUM(label) AS BIGINT) AS pos, CAST(SUM(1 - label) AS BIGINT) AS neg,
              round(SUM(label) / count(*), {R9}) AS prior,
              round(CASE WHEN SUM(label) > 0 AND SUM(1 - label) > 0 THEN ln(SUM(label) / SUM(1 - label)) END, {R9}) AS bias
       FROM {_TRAIN} GROUP BY setting, split"""))
def q_class_prior(spark, d):
    t = split_table(spark, d).where(F.col("part") == "train")
    c = M.class_prior(t, ["setting", "split"])
    return c.select("setting", "split", "pos", "neg", r9(F.col("prior")).alias("prior"), r9(F.col("bias")).alias("bias"))


@register("confusion", "A7 P11", with_splits(
    """SELECT split, CAST(count_if(api > 0.5 AND label = 1) AS BIGINT) AS tp,
              CAST(count_if(api > 0.5 AND label <> 1) AS BIGINT) AS fp,
              CAST(count_if(NOT api > 0.5 AND label <> 1) AS BIGINT) AS tn,
              CAST(count_if(NOT api > 0.5 AND label = 1) AS BIGINT) AS fn
       FROM split_table WHERE setting = 'gc' AND part = 'val' GROUP BY split"""))
def q_confusion(spark, d):
    return M.confusion(gc_val(spark, d), ["split"], score="api")


@register("threshold_metrics", "A8", with_splits(
    f"""SELECT split, tp, fp, tn, fn,
              round(CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0 END, {R9}) AS accuracy,
              round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, {R9}) AS precision,
              round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, {R9}) AS recall
       FROM (SELECT split, CAST(count_if(api > 0.5 AND label = 1) AS BIGINT) AS tp,
                    CAST(count_if(api > 0.5 AND label <> 1) AS BIGINT) AS fp,
                    CAST(count_if(NOT api > 0.5 AND label <> 1) AS BIGINT) AS tn,
                    CAST(count_if(NOT api > 0.5 AND label = 1) AS BIGINT) AS fn
             FROM split_table WHERE setting = 'gc' AND part = 'val' GROUP BY split)"""))
def q_threshold_metrics(spark, d):
    m = M.threshold_metrics(gc_val(spark, d), ["split"], score="api")
    return m.select("split", "tp", "fp", "tn", "fn", *[r9(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall")])


_BINNED = ("(SELECT split, label, 1 + greatest(0, least(198, CAST(ceil(api * 199.0::DOUBLE) AS BIGINT) - 1)) AS b "
           "FROM split_table WHERE setting = 'gc' AND part = 'val')")


@register("auc_binned", "A9", with_splits(
    f"SELECT split, n_pos, n_neg, round(COALESCE(auroc, 0.0), {R9}) AS auc_binned FROM ({auroc_sql(_BINNED, ['split'], 'b')})"))
def q_auc_binned(spark, d):
    a = M.auc_binned(gc_val(spark, d), ["split"], score="api", n_keys=SPLITS)
    return a.select("split", "n_pos", "n_neg", r9(F.col("auc_binned")).alias("auc_binned"))


def _delong_sql(source: str, keys: list[str], score: str) -> str:
    k = ", ".join(keys)
    w = f"PARTITION BY {k} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
      WITH g AS (SELECT {k}, {score} AS score,
                        CAST(SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos,
                        CAST(SUM(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS DOUBLE) AS neg
                 FROM {source} GROUP BY {k}, {score}),
      r AS (SELECT *, COALESCE(SUM(neg) OVER ({w}), 0) AS nb, COALESCE(SUM(pos) OVER ({w}), 0) AS pb,
                   SUM(pos) OVER (PARTITION BY {k}) AS P, SUM(neg) OVER (PARTITION BY {k}) AS N FROM g),
      c AS (SELECT {k}, P, N, pos, neg, (nb + 0.5::DOUBLE * neg) / N AS v10,
                   (P - pb - pos + 0.5::DOUBLE * pos) / P AS v01 FROM r),
      a AS (SELECT {k}, max(P) AS P, max(N) AS N, SUM(pos * v10) / max(P) AS auc,
                   SUM(pos * v10 * v10) AS q10, SUM(neg * v01 * v01) AS q01 FROM c GROUP BY {k}),
      v AS (SELECT {k}, P, N, auc, CASE WHEN P > 1 AND N > 1 THEN
                   (q10 - P * auc * auc) / (P - 1) / P + (q01 - N * auc * auc) / (N - 1) / N END AS variance FROM a)
      SELECT {k}, CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg, round(auc, {R9}) AS auroc,
             round(variance, {R9}) AS variance,
             round(greatest(0.0, auc - {M.Z_95} * sqrt(variance)), {R9}) AS ci_low,
             round(least(1.0, auc + {M.Z_95} * sqrt(variance)), {R9}) AS ci_high
      FROM v"""


@register("auroc_ci", "A10", with_splits(_delong_sql(_VAL, ["split"], "api")))
def q_auroc_ci(spark, d):
    a = M.auroc_ci(gc_val(spark, d), ["split"], score="api", n_keys=SPLITS)
    return a.select("split", "n_pos", "n_neg", *[r9(F.col(c)).alias(c) for c in ("auroc", "variance", "ci_low", "ci_high")])


def _draws_sql(replicate: str, key: str) -> str:
    limits = M.poisson_thresholds()
    digits = f"substr(md5(concat_ws(':', '{SEED}', ({replicate} - 1) // {M.DRAWS}, {key})), 8 * (({replicate} - 1) % {M.DRAWS}) + 1, 8)"
    return f"(SELECT CASE {' '.join(f'WHEN h < {chr(39)}{t}{chr(39)} THEN {k}' for k, t in enumerate(limits))} ELSE {len(limits)} END FROM (SELECT {digits} AS h))"


@register("auroc_bootstrap", "A10", with_splits(
    f"""WITH drawn AS (SELECT split, replicate, label, api, {_draws_sql('replicate', 'id')} AS n FROM (
          SELECT split, id, label, api, unnest(range(1, {REPLICATES + 1})) AS replicate FROM {_VAL})),
        steps AS (SELECT split, replicate, api, sum(n * label) AS pos, sum(n * (1 - label)) AS neg FROM drawn GROUP BY ALL),
        ranked AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY split, replicate ORDER BY api ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM steps),
        each AS (SELECT split, replicate, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                   THEN CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / (2.0 * sum(pos) * sum(neg)) END AS auroc FROM ranked GROUP BY ALL)
        SELECT w.split, round(w.auroc, {R9}) AS auroc, count(e.auroc) AS replicates, round(quantile_cont(e.auroc, 0.025), {R9}) AS ci_low,
               round(quantile_cont(e.auroc, 0.975), {R9}) AS ci_high
        FROM ({auroc_sql(_VAL, ['split'], 'api')}) w LEFT JOIN each e ON e.split = w.split GROUP BY w.split, w.auroc"""))
def q_auroc_bootstrap(spark, d):
    a = M.auroc_bootstrap(gc_val(spark, d), ["split"], score="api", replicates=REPLICATES, seed=SEED)
    return a.select("split", r9(F.col("auroc")).alias("auroc"), "replicates", *[r9(F.col(c)).alias(c) for c in ("ci_low", "ci_high")])


@register("calibration_in_large", "A12", with_splits(
    f"""SELECT split, round(avg(api), {R9}) AS mean_score, round(avg(CAST(label AS DOUBLE)), {R9}) AS gold_rate,
              count(*) AS n FROM split_table WHERE setting = 'gc' AND part = 'val' GROUP BY split"""))
def q_calibration(spark, d):
    c = M.calibration_in_large(gc_val(spark, d), ["split"], score="api")
    return c.select("split", r9(F.col("mean_score")).alias("mean_score"), r9(F.col("gold_rate")).alias("gold_rate"), "n")


# ---- J1 / A11 / U3 --------------------------------------------------------------------------------

@register("join_scores", "J1 S3", fx.with_fixtures(
    "SELECT gc.id, gc.label, gc.api, t.TOXICITY AS ca_score FROM gc LEFT JOIN toxicity_scores t ON gc.id = t.id",
    "toxicity_scores"))
def q_join_scores(spark, d):
    j = join_scores(fx.comments(spark, d), fx.toxicity_scores(spark, d), "TOXICITY")
    return j.select("id", "label", "api", "ca_score")


_CA_VAL = ("(SELECT v.split, v.label, t.TOXICITY AS ca_score FROM split_table v JOIN toxicity_scores t ON v.id = t.id "
           f"WHERE v.setting = 'gc' AND v.part = 'val' AND v.split < {POOLED})")


@register("ca_auroc_by_split", "A2 J1", fx.with_fixtures(
    f"""WITH split_table AS ({split_table_sql()})
        SELECT split, n_pos, n_neg, round(auroc, {R9}) AS auroc FROM ({auroc_sql(_CA_VAL, ['split'], 'ca_score')})""",
    "settings", "toxicity_scores"))
def q_ca_auroc_by_split(spark, d):
    v = gc_val(spark, d).where(F.col("split") < POOLED)
    j = join_scores(v, fx.toxicity_scores(spark, d), "TOXICITY")
    a = M.auroc(j, ["split"], score="ca_score", n_keys=SPLITS)
    return a.select("split", "n_pos", "n_neg", r9(F.col("auroc")).alias("auroc"))


def _metric_sql(evaluator: str, both: str) -> str:
    if evaluator == "auroc":
        return auroc_sql(both, ['replicate', 'system'])
    # accuracy at the 0.5 threshold (score > 0.5 predicts toxic)
    return f"""SELECT replicate, system, CAST(SUM(CASE WHEN (score > 0.5) = (label = 1) THEN 1 ELSE 0 END) AS DOUBLE)
                      / count(*) AS auroc FROM {both} GROUP BY replicate, system"""


def _paired_sql(evaluator: str = "auroc") -> str:
    digit = f"substr(md5(concat_ws(':', '{SEED}', (replicate - 1) // {M.SWAPS}, id)), (replicate - 1) % {M.SWAPS} + 1, 1)"
    both = f"""(SELECT replicate, 'system' AS system, label, CASE WHEN swap THEN api ELSE ca END AS score FROM sw
               UNION ALL SELECT replicate, 'baseline' AS system, label, CASE WHEN swap THEN ca ELSE api END AS score FROM sw)"""
    return f"""WITH split_table AS ({split_table_sql()}),
      pooled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY split) AS rn FROM split_table
                 WHERE setting = 'gc' AND part = 'val' AND split < {POOLED}) WHERE rn = 1),
      v AS (SELECT p.id, p.label, p.api, t.TOXICITY AS ca FROM pooled p JOIN toxicity_scores t ON p.id = t.id),
      rep AS (SELECT v.*, unnest(range(0, {REPLICATES + 1})) AS replicate FROM v),
      sw AS (SELECT replicate, id, label, ca, api, (replicate > 0 AND ca <> api AND {digit} < '8') AS swap FROM rep),
      m AS ({_metric_sql(evaluator, both)}),
      d AS (SELECT replicate, max(CASE WHEN system = 'system' THEN auroc END) AS s,
                   max(CASE WHEN system = 'baseline' THEN auroc END) AS b FROM m GROUP BY replicate)
      SELECT round(o.s, {R9}) AS metric_system, round(o.b, {R9}) AS metric_baseline, round(o.s - o.b, {R9}) AS delta,
             round((1 + (SELECT count(*) FROM d WHERE replicate > 0 AND abs(s - b) >= abs(o.s - o.b) - 1e-12::DOUBLE))
                   / {float(REPLICATES + 1)}::DOUBLE, {R9}) AS p_value,
             CAST({REPLICATES} AS BIGINT) AS replicates
      FROM d o WHERE replicate = 0"""


@register("paired_randomization", "A11 E3", fx.with_fixtures(_paired_sql(), "settings", "toxicity_scores"))
def q_paired_randomization(spark, d):
    pooled = S.pooled_eval_set(split_table(spark, d), POOLED)
    v = join_scores(pooled, fx.toxicity_scores(spark, d), "TOXICITY")
    p = M.paired_randomization(v, "ca_score", "api", replicates=REPLICATES, seed=SEED)
    return p.select(*[r9(F.col(c)).alias(c) for c in ("metric_system", "metric_baseline", "delta", "p_value")],
                    "replicates")


@register("paired_randomization_accuracy", "A11 E3", fx.with_fixtures(_paired_sql("accuracy"), "settings",
                                                                       "toxicity_scores"))
def q_paired_randomization_accuracy(spark, d):
    pooled = S.pooled_eval_set(split_table(spark, d), POOLED)
    v = join_scores(pooled, fx.toxicity_scores(spark, d), "TOXICITY")
    p = M.paired_randomization(v, "ca_score", "api", replicates=REPLICATES, seed=SEED, evaluator="accuracy")
    return p.select(*[r9(F.col(c)).alias(c) for c in ("metric_system", "metric_baseline", "delta", "p_value")],
                    "replicates")


@register("predictions_wide", "U3", with_splits(
    "SELECT id, " + ", ".join(f"max(CASE WHEN split = {i} THEN api END) AS split{i}" for i in range(SPLITS))
    + " FROM split_table WHERE setting = 'gc' AND part = 'val' GROUP BY id"))
def q_predictions_wide(spark, d):
    long = gc_val(spark, d).select("id", "split", F.col("api").alias("score"))
    return M.predictions_wide(long, list(range(SPLITS)))
