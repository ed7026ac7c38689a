"""Context regimes as Spark ML pipelines, dev-set selection with patience, repeated experiments.

The study compares classifiers that see the target text only with classifiers that also see the parent.
Each regime here is a Spark ML ``Pipeline`` (distributed fit, persistable) from rows (id, text, parent, label) to a
probability, with class weights, and is scored by the exact AUROC of :mod:`metrics`:

ooc           target text -> terms of the fitted vocabulary -> weighted logistic regression
inc_concat    target and parent encoded separately with one vocabulary, vectors concatenated
inc_pair      one pair sequence: target tokens tagged ``0:``, parent tokens tagged ``1:`` (whole texts
              by default; ``max_len`` applies the pair budget of the sequence-pair encoders)
inc_hybrid    pretrained word vectors pooled over the target (masked mean) + parent terms
inc_learnt    as inc_hybrid, with word vectors learnt on the training part
ooc_net       pooled target vectors -> multilayer perceptron (trained in rounds, see :mod:`networks`)
inc_net       pooled target and parent vectors -> multilayer perceptron

The vocabulary is fitted on the training rows: on their targets, or on targets and parents
(``augmented_vocabulary``); words it lacks carry no weight. Only the vocabulary's words (at most ``vocab_size``) and the
scalar metrics of each fit reach the driver; the loops over splits and candidates are loops over distributed fits, never
over rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from threading import Condition

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import RegexTokenizer, SQLTransformer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadtox.functions.text import WORD_FILTERS
from threadtox.operators import metrics as M
from threadtox.operators.stages import ClassWeight, FittedTerms, LearntVectors, PooledVectors, vector_length
from threadtox.session import discard, driver_bytes, materialize

REGIMES = ("ooc", "inc_concat", "inc_pair", "inc_hybrid", "inc_learnt")
NETWORKS = ("ooc_net", "inc_net")
ROWS_PER_TASK = 5_000   # featurised rows of a fit that are worth a task of their own
OPTIMISERS_MB = 768     # driver memory that optimisers and vocabularies take at once, at most
DRIVER_SHARE = 0.4      # as a share of the driver's heap
STATE_VECTORS = 40      # vectors as long as the features that an optimiser holds there (history, line search, partial sums)
VOCABULARY_BYTES = 400  # of a word while rows are encoded with it: the word, the dictionary, the form in which that is sent


@dataclass(frozen=True)
class TrainConfig:
    reg_param: float = 0.05
    max_iter: int = 50
    vocab_size: int = 1 << 18
    augmented_vocabulary: bool = False   # count the parents' words, too (inc_concat, inc_hybrid, inc_learnt)
    positive_weight: float = 1.0
    max_len: int | None = None           # pair budget of inc_pair (None: whole texts)
    vector_size: int = 32                # of the vectors that inc_learnt fits
    hidden: int = 16                     # hidden units of the networks
    seed: int = 42


def _split_pattern() -> str:
    """Java regex: one or more spaces / filter characters (each escaped inside the class)."""
    return "[" + "".join("\\" + c for c in " " + WORD_FILTERS) + "]+"


def _tokenizer(inp: str, out: str) -> RegexTokenizer:
    # the same tokens as functions.text.word_tokens: lower-case, split on runs of filter characters
    return RegexTokenizer(inputCol=inp, outputCol=out, pattern=_split_pattern(), gaps=True, toLowercase=True,
                          minTokenLength=1)


def _assemble(inputs: list[str]) -> list:
    """Concatenate vectors, then drop the assembler's per-slot attribute metadata (one entry per feature: it would
    otherwise travel in the plan of every optimiser iteration). ``element_at(array(x), 1)`` is an expression that the
    optimiser does not fold back to the attribute with its metadata, as it does ``coalesce(x)``."""
    one = inputs[0] if len(inputs) == 1 else "__assembled"
    return [*([VectorAssembler(inputCols=inputs, outputCol=one)] if len(inputs) > 1 else []),
            SQLTransformer(statement=f"SELECT *, element_at(array({one}), 1) AS features FROM __THIS__")]


def _pair(max_len: int | None) -> str:
    a, b = "__tt", "__pt"
    if max_len is not None:
        budget = max_len - 3
        a = f"slice(__tt, 1, least(size(__tt), greatest({budget} - size(__pt), {(budget + 1) // 2})))"
        b = f"slice(__pt, 1, least(size(__pt), greatest({budget} - size(__tt), {budget // 2})))"
    return f"concat(transform({a}, x -> concat('0:', x)), transform({b}, x -> concat('1:', x)))"


def feature_stages(regime: str, cfg: TrainConfig, vectors: DataFrame | None = None, key: str = "id") -> list:
    """The stages from (id, text, parent[, label]) to ``features`` (and ``weight``)."""
    clean = SQLTransformer(statement="SELECT *, coalesce(text, '') AS __text, coalesce(parent, '') AS __parent "
                                     "FROM __THIS__")
    stages = [ClassWeight(positiveWeight=cfg.positive_weight), clean, _tokenizer("__text", "__tt"), _tokenizer("__parent", "__pt")]
    counted = ["__tt", "__pt"] if cfg.augmented_vocabulary else ["__tt"]

    def pooled(tokens: str, out: str) -> list:
        if vectors is None:
            raise ValueError(f"{regime} needs a word-vector table")
        n = vector_length(vectors)
        return [PooledVectors(vectors, tokens, out, key, n), VectorSizeHint(inputCol=out, size=n)]

    if regime == "ooc":
        return stages + [FittedTerms(["__tt"], ["__tf"], ["__tt"], cfg.vocab_size), *_assemble(["__tf"])]
    if regime == "inc_concat":
        return stages + [FittedTerms(["__tt", "__pt"], ["__tf", "__pf"], counted, cfg.vocab_size), *_assemble(["__tf", "__pf"])]
    if regime == "inc_pair":
        return stages + [SQLTransformer(statement=f"SELECT *, {_pair(cfg.max_len)} AS __pair FROM __THIS__"),
                         FittedTerms(["__pair"], ["__rf"], ["__pair"], cfg.vocab_size), *_assemble(["__rf"])]
    if regime in ("inc_hybrid", "inc_learnt"):
        learnt = LearntVectors("__tt", "__pooled", key, size=cfg.vector_size, seed=cfg.seed)
        target = pooled("__tt", "__pooled") if regime == "inc_hybrid" else [learnt, VectorSizeHint(inputCol="__pooled", size=cfg.vector_size)]
        return stages + [*target, FittedTerms(["__pt"], ["__pf"], counted, cfg.vocab_size), *_assemble(["__pooled", "__pf"])]
    if regime == "ooc_net":
        return stages + [*pooled("__tt", "__pooled"), *_assemble(["__pooled"])]
    if regime == "inc_net":
        return stages + [*pooled("__tt", "__pooled"), *pooled("__pt", "__context"), *_assemble(["__pooled", "__context"])]
    raise ValueError(f"regime must be one of {REGIMES + NETWORKS}")


def classifier(cfg: TrainConfig) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=cfg.reg_param,
                              maxIter=cfg.max_iter, standardization=False, probabilityCol="probability")


def build_pipeline(regime: str, cfg: TrainConfig = TrainConfig(), vectors: DataFrame | None = None, key: str = "id") -> Pipeline:
    if regime not in REGIMES:
        raise ValueError(f"regime must be one of {REGIMES}")
    return Pipeline(stages=feature_stages(regime, cfg, vectors, key) + [classifier(cfg)])


def fit(regime: str, train: DataFrame, cfg: TrainConfig = TrainConfig(), vectors: DataFrame | None = None,
        key: str = "id") -> PipelineModel:
    """``build_pipeline(...).fit(train)``, with the featurised rows written before the optimiser reads them."""
    features, [own] = encoded(regime, cfg, vectors, key, train)
    with optimiser(own):
        model = classifier(cfg).fit(own)
    discard(own)
    return PipelineModel([*features.stages, model])


def predict(model: PipelineModel, df: DataFrame, key: str = "id", keep: Sequence[str] = ("label",)) -> DataFrame:
    """key, kept columns, score = P(toxic), for rows (id, text, parent); the model needs nothing else."""
    return model.transform(df).select(key, *keep, vector_to_array(F.col("probability"))[1].alias("score"))


def encoded(regime: str, cfg: TrainConfig, vectors: DataFrame | None, key: str, train: DataFrame, *others: DataFrame,
            together: int = 1) -> tuple[PipelineModel, list[DataFrame]]:
    """The feature stages fitted on ``train``, and all parts featurised with them (to be discarded by the caller)."""
    with driver_room(train.sparkSession, VOCABULARY_BYTES * cfg.vocab_size):
        features = Pipeline(stages=feature_stages(regime, cfg, vectors, key)).fit(train)
        rows = featurised(features, train, *others, key=key, together=together)
        return features.copy(), rows  # a copy has the words, not the dictionary of them that the driver shared


def featurised(stages: PipelineModel, *parts: DataFrame, key: str = "id", together: int = 1) -> list[DataFrame]:
    """The parts as (key, label, weight, features), written once: every job of an optimiser carries the plan of its rows,
    and all it holds (vocabularies, tables). Each iteration is a job that moves a gradient from every partition, so
    there are as many as rows are worth a task, and never more than the cores that each of the ``together`` fits side by
    side can have."""
    held = []
    for df in parts:
        rows = materialize(stages.transform(df).select(key, "label", "weight", "features"), "features")
        cores = -(-rows.sparkSession.sparkContext.defaultParallelism // together)
        held.append(rows.coalesce(max(1, min(cores, -(-rows.count() // ROWS_PER_TASK)))))
    return held


_ROOM, _TAKEN = Condition(), [0]   # bytes


@contextmanager
def driver_room(spark: SparkSession, need: int) -> Iterator[None]:
    """Waits until the driver has room for ``need`` bytes more (always, if nothing holds any): side by side, fits and the
    vocabularies that encode their rows take a share of its heap. Not to be nested."""
    most = min(OPTIMISERS_MB * 1e6, DRIVER_SHARE * driver_bytes(spark))
    with _ROOM:
        _ROOM.wait_for(lambda: not _TAKEN[0] or _TAKEN[0] + need <= most)
        _TAKEN[0] += need
    try:
        yield
    finally:
        with _ROOM:
            _TAKEN[0] -= need
            _ROOM.notify_all()


def optimiser(rows: DataFrame):
    """Room on the driver for an optimiser over the features of ``rows``."""
    first = rows.select("features").first()
    return driver_room(rows.sparkSession, STATE_VECTORS * 8 * (first.features.size if first else 0))


# ---- selection on the dev part (X5 / M7) ----------------------------------------------------------

def select_best(candidates: DataFrame, order: str = "candidate", metric: str = "metric",
                patience: int = 3, decimals: int | None = 12) -> DataFrame:
    """Early stopping over an ordered candidate table: walk candidates in order, stop once ``patience``
    consecutive candidates fail to improve on the best so far; return the best evaluated candidate
    (earliest on ties): best_candidate, best_metric, stopped_at, evaluated.

    Metrics are compared after rounding to ``decimals``: two equal fractions reached through different
    counts (14/17 = 28/34) can differ in the last bit, and that noise must neither count as an
    improvement nor break a tie. The candidate table is small (one row per checkpoint / grid point), so
    plain windows are used.
    """
    w = Window.orderBy(order)
    m = F.col(metric) if decimals is None else F.round(F.col(metric), decimals)
    c = candidates.select(order, m.alias(metric)).withColumn("__best_before", F.max(metric).over(
        w.rowsBetween(Window.unboundedPreceding, -1)))
    c = c.withColumn("__improved", F.col("__best_before").isNull() | (F.col(metric) > F.col("__best_before")))
    c = c.withColumn("__rank", F.row_number().over(w))
    # consecutive non-improving count = rank - rank of the last improving candidate
    last_rank = F.max(F.when(F.col("__improved"), F.col("__rank"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("__run", F.col("__rank") - last_rank)
    stop = c.where(F.col("__run") >= F.lit(patience)).agg(F.min("__rank").alias("__stop"))
    bounded = (c.withColumn("__one", F.lit(1))
               .join(F.broadcast(stop.withColumn("__one", F.lit(1))), "__one", "left")
               .where(F.col("__stop").isNull() | (F.col("__rank") <= F.col("__stop"))))
    best = bounded.agg(
        # a candidate without a metric (dev part missing a class) is never the best: min_by skips nulls
        F.min_by(F.col(order), F.when(F.col(metric).isNotNull(), F.struct(-F.col(metric), F.col("__rank"))))
        .alias("best_candidate"),
        F.max(F.col(metric)).alias("best_metric"),
        F.max(F.col(order)).alias("stopped_at"),
        F.count(F.lit(1)).alias("evaluated"))
    return best


def dev_auroc(model, rows: DataFrame) -> float | None:
    scored = model.transform(rows).select("label", vector_to_array(F.col("probability"))[1].alias("score"))
    return M.auroc(scored, score="score").first()["auroc"]


class Patience:
    """Early stopping as in :func:`select_best`: metrics are compared at 12 decimals, the earliest best is kept."""

    def __init__(self, patience: int):
        self.patience, self.best, self.metric, self.stale = patience, None, None, 0

    def done(self, candidate, metric: float | None) -> bool:
        """Takes the next candidate; whether the walk ends with it."""
        if self.best is None or (metric is not None and (self.metric is None or round(metric, 12) > round(self.metric, 12))):
            self.best, self.metric, self.stale = candidate, metric, 0
        else:
            self.stale += 1
        return self.stale >= self.patience


def fit_with_dev_selection(regime: str, train: DataFrame, dev: DataFrame, grid: Sequence[float],
                           cfg: TrainConfig = TrainConfig(), patience: int = 3, vectors: DataFrame | None = None,
                           key: str = "id") -> tuple[PipelineModel, list[tuple[int, float, float]]]:
    """Fit one model per regularisation strength in ``grid`` (strong to weak, like growing training
    budgets), score the dev part, stop after ``patience`` candidates without a dev-AUROC gain, and
    return the best model with the (candidate, reg_param, dev_auroc) history.

    The feature stages are fitted on the training part once; train and dev are featurised and written once for the whole
    grid. Candidates do not depend on each other, and a fit is a chain of small jobs that waits more than it computes:
    they are fitted side by side, as many as the driver has room for, and walked in order; those behind the stop are
    not looked at."""
    features, (own, held) = encoded(regime, cfg, vectors, key, train, dev, together=max(1, len(grid)))
    lr, watch, history = classifier(cfg), Patience(patience), []

    def candidate(reg: float):
        with optimiser(own):
            model = lr.copy({lr.regParam: float(reg)}).fit(own)
        return model, dev_auroc(model, held)

    with ThreadPoolExecutor(max_workers=max(1, len(grid))) as pool:
        fits = [pool.submit(candidate, reg) for reg in grid]
        for i, (reg, done) in enumerate(zip(grid, fits, strict=True)):
            model, metric = done.result()
            history.append((i, float(reg), metric))
            if watch.done(model, metric):
                for later in fits[i + 1:]:
                    later.cancel()
                break
    discard(own)  # no fit goes on: the pool has ended
    discard(held)
    return PipelineModel([features, watch.best]), history
