"""Registered queries: context regimes, networks trained in rounds, selection, repeated experiments, transfer, persistence
(M1-M9, X5, K4). Scores have no SQL form; what is deterministic of them has: which comments are scored, with which label,
within [0, 1] (``regime_predictions``, ``mccv_predictions``), the fitted vocabularies and what they encode
(``fitted_vocabulary``, ``encoded_terms``), the copies that realise class weights, equal scores after a reload.
``select_best`` is a SQL window query."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from threadtox.functions.hashing import duckdb_uniform as U
from threadtox.functions.text import word_tokens_sql
from threadtox.operators import metrics as M
from threadtox.operators import models as ML
from threadtox.operators import networks as N
from threadtox.operators import splits as S
from threadtox.operators import text as T
from threadtox.operators.features import binarize, class_weight
from threadtox.operators.stages import FittedTerms
from threadtox.plans.evaluation import R9, SEED, r9, split_table, with_splits, with_text
from threadtox.plans.io import CAP
from threadtox.plans.registry import register
from threadtox.plans.sql import SPLITS
from threadtox.session import driver_bytes, materialized_once, scratch_path
from threadtox.sources import fixtures as fx
from threadtox.sources.files import capped_scan

CFG = ML.TrainConfig()
GRID = (1.0, 0.3, 0.1, 0.03, 0.01)   # regularisation strengths tried on the dev part, strong to weak
PATIENCE = 3                          # candidates without a gain before the study stops
REPEATS = 5                           # Monte-Carlo repetitions of the study
RUN_MB = 300                          # of the driver's heap for each run that goes on at once
ROUNDS = (5,) * 12                    # optimiser iterations of a network's rounds, each followed by the dev part


def _parts(spark, d, split: int, setting: str = "gc"):
    rows = with_text(spark, d, S.scan_split(split_table(spark, d), split, setting))
    train = rows.where(F.col("part") == "train")
    dev = rows.where(F.col("part") == "dev")
    val = rows.where(F.col("part") == "val")
    return train, dev, val


def select(regime: str, train, dev, vectors=None):
    """The model that does best on the dev part, as every experiment of the study picks it."""
    return ML.fit_with_dev_selection(regime, train, dev, GRID, CFG, PATIENCE, vectors)[0]


def _vectors(spark, d, regime: str):
    return fx.word_vectors(spark, d) if regime in ("inc_hybrid", *ML.NETWORKS) else None


def _one_run(spark, d, regime: str, setting: str, i: int):
    """One repetition: the model that does best on the dev part, its scores of the val part."""
    train, dev, val = _parts(spark, d, i, setting)
    vec = _vectors(spark, d, regime)
    if regime in ML.NETWORKS:
        model, _ = N.fit_network(regime, train, dev, vec, ROUNDS, CFG, PATIENCE)
    else:
        model = select(regime, train, dev, vec)
    return ML.predict(model, val, keep=("split", "label"))


def one_run(spark, d, regime: str, setting: str, i: int):
    """The predictions (id, split, label, score) of a repetition, written once: every evaluation reads them."""
    return materialized_once(spark, ("run", d, regime, setting, i), lambda: _one_run(spark, d, regime, setting, i))


def _regime_query(regime: str):
    def build(spark, d):
        return one_run(spark, d, regime, "gc", 0)
    build.__name__ = f"q_clf_{regime}"
    return build


register("clf_ooc", "M1", heavy=True)(_regime_query("ooc"))
register("clf_ooc_net", "M1 M7", heavy=True)(_regime_query("ooc_net"))
register("clf_inc_concat", "M2", heavy=True)(_regime_query("inc_concat"))
register("clf_inc_pair", "M3", heavy=True)(_regime_query("inc_pair"))
register("clf_inc_hybrid", "M4", heavy=True)(_regime_query("inc_hybrid"))
register("clf_inc_learnt", "M4", heavy=True)(_regime_query("inc_learnt"))
register("clf_inc_net", "M2 M4 M7", heavy=True)(_regime_query("inc_net"))

ALL = ML.REGIMES + ML.NETWORKS


@register("regime_predictions", "M1 M2 M3 M4", with_splits(
    "SELECT regime, id, split, label, true AS in_range FROM split_table, (VALUES "
    + ", ".join(f"('{r}')" for r in ALL) + """) r(regime) WHERE setting = 'gc' AND part = 'val' AND split = 0"""), heavy=True)
def q_regime_predictions(spark, d):
    """What is deterministic of every regime's predictions."""
    _inputs(spark, d, ALL)
    _runs_at_once([lambda r=r: one_run(spark, d, r, "gc", 0) for r in ALL])
    return reduce(lambda a, b: a.unionByName(b), [one_run(spark, d, r, "gc", 0).select(
        F.lit(r).alias("regime"), "id", "split", "label", F.col("score").between(0.0, 1.0).alias("in_range")) for r in ALL])


WEIGHT = 2.7   # weight of a toxic comment in the copies query


@register("weighted_copies", "M1 P6", with_splits(
    f"""SELECT id, label, CASE WHEN label <> 1 THEN 1 ELSE CAST(floor({WEIGHT}::DOUBLE) AS INTEGER)
              + CASE WHEN {U("concat('copy:', id)")} < {WEIGHT}::DOUBLE - floor({WEIGHT}::DOUBLE) THEN 1 ELSE 0 END END AS copies
       FROM split_table WHERE setting = 'gc' AND split = 0 AND part = 'train'"""))
def q_weighted_copies(spark, d):
    """How often each training row appears before a learner without weights."""
    train = split_table(spark, d).where("setting = 'gc' AND split = 0 AND part = 'train'").select("id", "label")
    weighted = train.withColumn("weight", class_weight(F.col("label"), WEIGHT))
    return N.replicate(weighted).groupBy("id", "label").agg(F.count("*").cast("int").alias("copies"))


@register("network_history", "M7", heavy=True)
def q_network_history(spark, d):
    """The rounds of a network's training: iterations so far, dev AUROC, and which round was kept."""
    train, dev, _ = _parts(spark, d, 0)
    _, history = N.fit_network("ooc_net", train, dev, fx.word_vectors(spark, d), ROUNDS, CFG, PATIENCE)
    table = spark.createDataFrame([(h.number, h.iterations, h.dev_auroc) for h in history], "candidate int, iterations int, dev_auroc double")
    return _flag_best(table, ML.select_best(table, "candidate", "dev_auroc", PATIENCE))


def _words_sql(column: str) -> str:
    return f"COALESCE({word_tokens_sql(column)}, [])"


_FITTED_SQL = f"""train AS (SELECT text, parent FROM split_table WHERE setting = 'gc' AND split = 0 AND part = 'train'),
  target AS (SELECT word, count(*) AS n FROM (SELECT unnest({_words_sql('text')}) AS word FROM train) GROUP BY word),
  augmented AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_concat({_words_sql('text')}, {_words_sql('parent')})) AS word FROM train) GROUP BY word)"""


def _term_stage(augmented: bool):
    return FittedTerms(["tt", "pt"], ["tf", "pf"], ["tt", "pt"] if augmented else ["tt"], CFG.vocab_size)


def _branches(rows):
    return T.tokenize(T.tokenize(rows, "text", "tt"), "parent", "pt")


@register("fitted_vocabulary", "M2 M4 P3", with_splits(
    f"""WITH {_FITTED_SQL}
    SELECT 'target' AS counted, word, CAST(row_number() OVER (ORDER BY n DESC, word) AS INTEGER) AS place FROM target
    UNION ALL SELECT 'augmented', word, CAST(row_number() OVER (ORDER BY n DESC, word) AS INTEGER) FROM augmented"""))
def q_fitted_vocabulary(spark, d):
    """The vocabularies that the regimes encode with: of the training targets, and of targets and parents."""
    train = _branches(_parts(spark, d, 0)[0])
    parts = []
    for name, augmented in (("target", False), ("augmented", True)):
        words = _term_stage(augmented).fit(train).stages[0].vocabulary
        parts.append(spark.createDataFrame([(name, w, i) for i, w in enumerate(words) if w], "counted string, word string, place int"))
    return parts[0].unionByName(parts[1])


@register("encoded_terms", "M2 M4 P3", with_splits(
    f"""WITH {_FITTED_SQL},
  val AS (SELECT id, {_words_sql('text')} AS tt, {_words_sql('parent')} AS pt FROM split_table WHERE setting = 'gc' AND split = 0 AND part = 'val'),
  known AS (SELECT (SELECT list(word) FROM target) AS target, (SELECT list(word) FROM augmented) AS augmented)
  SELECT id, counted, CAST(len(list_intersect(list_distinct(tt), words)) AS INTEGER) AS target_terms,
         CAST(len(list_intersect(list_distinct(pt), words)) AS INTEGER) AS parent_terms
  FROM val, (SELECT 'target' AS counted, target AS words FROM known UNION ALL SELECT 'augmented', augmented FROM known)"""))
def q_encoded_terms(spark, d):
    """How many terms of each branch of the val rows carry weight under either vocabulary."""
    train, _, val = (_branches(x) for x in _parts(spark, d, 0))
    parts = []
    for name, augmented in (("target", False), ("augmented", True)):
        coded = _term_stage(augmented).fit(train).transform(val)
        size = [F.size(F.unwrap_udt(c)["indices"]).alias(n) for c, n in (("tf", "target_terms"), ("pf", "parent_terms"))]
        parts.append(coded.select("id", F.lit(name).alias("counted"), *size))
    return parts[0].unionByName(parts[1])


@register("predict", "M6", heavy=True)
def q_predict(spark, d):
    """Batch scoring of every comment with a model fitted on one training part."""
    train, dev, _ = _parts(spark, d, 0)
    model = select("ooc", train, dev)
    return ML.predict(model, fx.comments(spark, d))


@register("dev_selection", "M7", heavy=True)
def q_dev_selection(spark, d):
    train, dev, _ = _parts(spark, d, 0)
    _, history = ML.fit_with_dev_selection("ooc", train, dev, GRID, CFG, patience=PATIENCE)
    table = spark.createDataFrame(history, "candidate int, reg_param double, dev_auroc double")
    best = ML.select_best(table, "candidate", "dev_auroc", PATIENCE)
    return _flag_best(table, best)


def _flag_best(table, best):
    b = best.select(F.col("best_candidate").alias("candidate"), F.lit(True).alias("selected"))
    return table.join(b, "candidate", "left").withColumn("selected", F.coalesce(F.col("selected"), F.lit(False)))


_DEV = "(SELECT * FROM split_table WHERE setting = 'gc' AND part = 'dev')"


def _select_best_sql(patience: int) -> str:
    from threadtox.plans.sql import auroc_sql
    return f"""WITH cand AS (SELECT split AS candidate, round(auroc, 12) AS metric
                           FROM ({auroc_sql(_DEV, ['split'], 'api')})),
      c AS (SELECT *, max(metric) OVER (ORDER BY candidate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb,
                   row_number() OVER (ORDER BY candidate) AS rk FROM cand),
      d AS (SELECT *, (bb IS NULL OR metric > bb) AS imp FROM c),
      e AS (SELECT *, rk - max(CASE WHEN imp THEN rk END) OVER (ORDER BY candidate ROWS BETWEEN UNBOUNDED PRECEDING
                   AND CURRENT ROW) AS run FROM d),
      s AS (SELECT min(rk) AS stop FROM e WHERE run >= {patience}),
      b AS (SELECT e.* FROM e, s WHERE s.stop IS NULL OR e.rk <= s.stop)
      SELECT CAST(arg_min(candidate, (-metric, rk)) FILTER (WHERE metric IS NOT NULL) AS INTEGER) AS best_candidate, round(max(metric), {R9}) AS best_metric,
             CAST(max(candidate) AS INTEGER) AS stopped_at, count(*) AS evaluated FROM b"""


@register("select_best", "X5", with_splits(_select_best_sql(3)))
def q_select_best(spark, d):
    st = split_table(spark, d).where((F.col("setting") == "gc") & (F.col("part") == "dev"))
    cand = M.auroc(st, ["split"], score="api", n_keys=SPLITS).select(F.col("split").alias("candidate"), F.col("auroc").alias("metric"))
    b = ML.select_best(cand, "candidate", "metric", 3)
    return b.select(F.col("best_candidate").cast("int").alias("best_candidate"), r9(F.col("best_metric")).alias("best_metric"),
                    F.col("stopped_at").cast("int").alias("stopped_at"), "evaluated")


def _runs_at_once(jobs):
    """Independent distributed fits side by side: each is many small jobs, which fill a cluster only together. As many as the
    driver's heap can hold the vocabularies and models of."""
    heap = driver_bytes(SparkSession.active())
    with ThreadPoolExecutor(max_workers=max(1, min(4, int(heap // (RUN_MB * 1e6))))) as pool:
        return list(pool.map(lambda job: job(), jobs))


def _inputs(spark, d, regimes):
    """What several runs read is written before they start, not once in each of them."""
    split_table(spark, d)
    for regime in regimes:
        _vectors(spark, d, regime)


def mccv_experiment(spark, d, regime: str, setting: str, repeats: int = REPEATS):
    """Train/dev from ``setting``, val always from gc: the long predictions (split, id, label, score) of all
    repetitions, each written once (the study keeps them), read by every evaluation."""
    _inputs(spark, d, [regime])
    runs = _runs_at_once([lambda i=i: one_run(spark, d, regime, setting, i) for i in range(repeats)])
    return reduce(lambda a, b: a.unionByName(b), runs)


def evaluate(preds):
    """Per split: AUROC with its interval, and mean predicted against mean gold."""
    auc = M.auroc_ci(preds, ["split"], score="score", n_keys=SPLITS)
    return auc.join(M.calibration_in_large(preds, ["split"], score="score"), "split")


@register("mccv_experiment", "M8 A2 A3", heavy=True)
def q_mccv_experiment(spark, d):
    scores = M.auroc(mccv_experiment(spark, d, "ooc", "gn"), ["split"], score="score", n_keys=SPLITS)
    summary = M.mccv_summary(scores)
    return scores.withColumn("__one", F.lit(1)).join(F.broadcast(summary.withColumn("__one", F.lit(1))), "__one") \
        .drop("__one")


@register("mccv_evaluation", "M8 A2 A10 A12", heavy=True)
def q_mccv_evaluation(spark, d):
    return evaluate(mccv_experiment(spark, d, "ooc", "gn"))


# what is deterministic of the predictions: which comments are scored in which repetition, with which label, within [0, 1]
@register("mccv_predictions", "M6 M8 K2", with_splits(
    f"""SELECT id, split, label, true AS in_range FROM split_table
        WHERE setting = 'gc' AND part = 'val' AND split < {REPEATS}"""), heavy=True)
def q_mccv_predictions(spark, d):
    p = mccv_experiment(spark, d, "ooc", "gn")
    return p.select("id", "split", "label", F.col("score").between(0.0, 1.0).alias("in_range"))


MATRIX = (("gn", "ooc"), ("gc", "ooc"), ("gc", "inc_concat"), ("gc", "inc_pair"), ("gc", "inc_hybrid"))
LEARNT = (("gc", "inc_learnt"), ("gc", "ooc_net"), ("gc", "inc_net"))


def _matrix(spark, d, cells):
    # the runs of all cells in one line: no cell waits for the last run of another
    _inputs(spark, d, [regime for _, regime in cells])
    _runs_at_once([lambda r=regime, s=setting, i=i: one_run(spark, d, r, s, i) for setting, regime in cells for i in range(REPEATS)])
    out = []
    for setting, regime in cells:
        scores = M.auroc(mccv_experiment(spark, d, regime, setting), ["split"], score="score", n_keys=SPLITS)
        out.append(M.mccv_summary(scores).select(F.lit(setting).alias("setting"), F.lit(regime).alias("regime"), "*"))
    return reduce(lambda a, b: a.unionByName(b), out)


@register("regime_matrix", "M9", heavy=True)
def q_regime_matrix(spark, d):
    return _matrix(spark, d, MATRIX)


@register("regime_matrix_learnt", "M9 M1 M4", heavy=True)
def q_regime_matrix_learnt(spark, d):
    """The regimes with learnt vectors and with networks."""
    return _matrix(spark, d, LEARNT)


@register("transfer_eval", "M5 S4 X4 P1 P4 X2", heavy=True)
def q_transfer_eval(spark, d):
    corpus = capped_scan(fx.cctk(spark, d), CAP).select("id", F.col("comment_text").alias("text"), F.lit(None).cast("string").alias("parent"),
                                      binarize(F.col("target")).alias("label"))
    parts = S.holdout_split(corpus, test_size=0.1, seed=SEED)
    model = select("ooc", parts.where(F.col("part") == "train"), parts.where(F.col("part") == "dev"))
    val = with_text(spark, d, split_table(spark, d).where((F.col("setting") == "gc") & (F.col("part") == "val")))
    preds = ML.predict(model, val, keep=("split", "label"))
    return M.auroc(preds, ["split"], score="score", n_keys=SPLITS)


def _roundtrip(spark, d, regime: str):
    """Scores before and after a reload. The loaded pipeline gets (id, text, parent) and nothing else: vocabulary, word
    vectors and class weights are its own."""
    train, _, val = _parts(spark, d, 0)
    model = ML.fit(regime, train, CFG, _vectors(spark, d, regime))
    path = scratch_path(spark, "model")
    model.write().save(path)
    again = PipelineModel.load(path)
    rows = val.select("id", "text", "parent")
    a = ML.predict(model, rows, keep=()).select("id", F.col("score").alias("score"))
    b = ML.predict(again, rows, keep=()).select("id", F.col("score").alias("score_reloaded"))
    return a.join(b, "id").select("id", (F.col("score") == F.col("score_reloaded")).alias("same"))


_SAME = with_splits("SELECT id, true AS same FROM split_table WHERE setting = 'gc' AND split = 0 AND part = 'val'")


@register("model_roundtrip", "K4", _SAME, heavy=True)
def q_model_roundtrip(spark, d):
    return _roundtrip(spark, d, "ooc")


@register("hybrid_roundtrip", "K4 M4", _SAME, heavy=True)
def q_hybrid_roundtrip(spark, d):
    return _roundtrip(spark, d, "inc_hybrid")
