"""Non-linear classifiers trained in rounds under the eye of the dev part.

The study trains its networks for up to a hundred epochs, measures the dev part after each and stops when it no longer
gains. Here a round is a number of optimiser iterations of Spark's multilayer perceptron, started from the weights of
the round before, so training goes on instead of beginning anew.

The perceptron takes no weight column. Class weights are realised by copies of rows: a row of weight w appears floor(w)
times, and once more with the probability of the rest, drawn from a hash of its id, so the copies are the same on every
run and machine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadtox.functions.hashing import uniform
from threadtox.operators.models import NETWORKS, ROWS_PER_TASK, Patience, TrainConfig, dev_auroc, feature_stages
from threadtox.operators.models import predict as predict  # the same for every regime


def copies(weight: Column, key: Column) -> Column:
    """How often a row of this weight appears: floor(w), and once more if the draw of its id is below the rest.
    A weight that is null, negative or no number counts as 0."""
    w = F.when(weight > 0, F.nanvl(weight, F.lit(0.0))).otherwise(F.lit(0.0))
    draw = uniform(F.concat(F.lit("copy:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.floor(w) + F.when(draw < w - F.floor(w), 1).otherwise(0)).cast("int")


def replicate(df: DataFrame, weight: str = "weight", key: str = "id") -> DataFrame:
    """Each row as often as :func:`copies` says; rows of weight 0 go. A narrow step: copies stay where the row is."""
    return df.withColumn("__copies", copies(F.col(weight), F.col(key))).filter("__copies > 0") \
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies", "__copy")


@dataclass(frozen=True)
class Round:
    """One round of training: iterations so far, and what the dev part says."""

    number: int
    iterations: int
    dev_auroc: float | None


def continue_training(own: DataFrame, layers: Sequence[int], iterations: int, weights=None, seed: int = 42):
    """``iterations`` optimiser steps of a perceptron over (label, features), from ``weights`` if given."""
    net = MultilayerPerceptronClassifier(layers=list(layers), maxIter=iterations, tol=0.0, seed=seed, solver="l-bfgs",
                                         featuresCol="features", labelCol="label", probabilityCol="probability")
    if weights is not None:
        net = net.setInitialWeights(weights)
    return net.fit(own)


def train_rounds(own: DataFrame, held: DataFrame, layers: Sequence[int], rounds: Sequence[int], patience: int = 3, seed: int = 42):
    """(best model, history): one round after another on (label, features), the dev rows scored after each, until
    ``patience`` rounds bring no gain or ``rounds`` (the iterations of each) ends."""
    watch, history, weights, done = Patience(patience), [], None, 0
    for number, iterations in enumerate(rounds):
        model = continue_training(own, layers, iterations, weights, seed)
        weights, done = model.weights, done + iterations
        metric = dev_auroc(model, held)
        history.append(Round(number, done, metric))
        if watch.done(model, metric):
            break
    return watch.best, history


@contextmanager
def held_rows(stages: PipelineModel, *parts: DataFrame, key: str = "id") -> Iterator[list[DataFrame]]:
    """The parts as (key, label, weight, features), held in the order they come in: a perceptron's gradient is small, but few
    iterations of it depend on the order in which rows are summed. A small part is held in few partitions."""
    held = []
    try:
        for df in parts:
            held.append(stages.transform(df).select(key, "label", "weight", "features").persist(StorageLevel.MEMORY_AND_DISK))
        yield [x.coalesce(max(1, -(-x.count() // ROWS_PER_TASK))) for x in held]
    finally:
        for x in held:
            x.unpersist()


def fit_network(regime: str, train: DataFrame, dev: DataFrame, vectors: DataFrame, rounds: Sequence[int], cfg: TrainConfig = TrainConfig(),
                patience: int = 3, key: str = "id") -> tuple[PipelineModel, list[Round]]:
    """The best network of the regime (``ooc_net``, ``inc_net``) on the dev part, and the rounds walked."""
    if regime not in NETWORKS:
        raise ValueError(f"regime must be one of {NETWORKS}")
    features = Pipeline(stages=feature_stages(regime, cfg, vectors, key)).fit(train)
    with held_rows(features, train, dev, key=key) as (own, held):
        first = own.select("features").first()
        if first is None:
            raise ValueError("no rows to train on")
        layers = [first.features.size, cfg.hidden, 2]
        best, history = train_rounds(replicate(own, key=key).select("label", "features"), held, layers, rounds, patience, cfg.seed)
    return PipelineModel([features, best]), history
