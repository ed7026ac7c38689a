import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from threadtox.functions.hashing import uniform_py
from threadtox.operators import metrics as M
from threadtox.operators import models as ML
from threadtox.operators import networks as N
from threadtox.sources import fixtures as fx


def xor(spark, n=400):
    """Label = whether exactly one coordinate is large: no linear model separates it."""
    rows = [(i, int((i % 2) != (i // 2 % 2)), 1.0, Vectors.dense([i % 2 + 0.01 * (i % 7), i // 2 % 2 - 0.01 * (i % 5)])) for i in range(n)]
    return spark.createDataFrame(rows, ["id", "label", "weight", "features"]).withColumn("label", F.col("label").cast("int")).coalesce(2).cache()


def test_network_separates_what_logistic_regression_cannot(spark):
    df = xor(spark)
    net, history = N.train_rounds(df.select("label", "features"), df, [2, 8, 2], (10,) * 20, patience=20, seed=3)
    linear = ML.classifier(ML.TrainConfig(reg_param=0.0)).fit(df)
    assert ML.dev_auroc(net, df) > 0.99 and ML.dev_auroc(linear, df) < 0.7 and len(history) >= 1


def test_rounds_continue_from_the_last_weights(spark):
    """Without a hidden layer the loss has one minimum: rounds reach the weights of one long training."""
    rows = [(int((i * 7919) % 10 < 3 + 4 * (i % 2)), Vectors.dense([i % 2 - 0.5, ((i * 31) % 11) / 11 - 0.5])) for i in range(300)]
    df = spark.createDataFrame(rows, ["label", "features"]).coalesce(2).cache()
    one = N.continue_training(df, [2, 2], 120, seed=5)
    weights = None
    losses = []
    for _ in range(12):
        model = N.continue_training(df, [2, 2], 10, weights, seed=5)
        weights = model.weights
        losses.append(-sum(math.log(r.probability[r.label]) for r in model.transform(df).collect()))
    assert weights.toArray() == pytest.approx(one.weights.toArray(), abs=1e-3)
    assert all(b <= a + 1e-6 for a, b in zip(losses, losses[1:]))
    start = N.continue_training(df, [2, 2], 1, weights, seed=99).weights.toArray()  # no seed matters once weights are given
    assert start == pytest.approx(weights.toArray(), abs=1e-2)


def test_training_stops_by_patience_and_keeps_the_best_round(spark):
    """The dev labels are drawn apart from the features, so the dev part soon stops to gain."""
    own = xor(spark)
    held = own.withColumn("label", F.when(F.pmod(F.hash("id"), F.lit(2)) == 0, 1).otherwise(0))
    best, history = N.train_rounds(own.select("label", "features"), held, [2, 4, 2], (5,) * 40, patience=2, seed=1)
    metrics = [h.dev_auroc for h in history]
    assert len(history) < 40 and [h.iterations for h in history] == [5 * (i + 1) for i in range(len(history))]
    table = spark.createDataFrame([(h.number, h.dev_auroc) for h in history], "candidate int, metric double")
    chosen = ML.select_best(table, patience=2).first()
    assert ML.dev_auroc(best, held) == pytest.approx(metrics[chosen.best_candidate]) and chosen.stopped_at == len(history) - 1


def test_copies_realise_weights(spark):
    rows = [(1, 0.0), (2, 1.0), (3, 3.0), (4, None), (5, -2.0), (6, float("nan")), (None, 2.0)] + [(i, 2.4) for i in range(100, 1100)] + [(7, 1.0), (7, 1.0)]
    df = spark.createDataFrame(rows, "id long, weight double")
    got = {r.id: r.n for r in N.replicate(df).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert got[2] == 1 and got[3] == 3 and got[None] == 2 and got[7] == 2 and not {1, 4, 5, 6} & set(got)
    assert all(got[i] == 2 + (uniform_py(f"copy:{i}") < 2.4 - 2) for i in range(100, 1100))
    assert 2.3 < sum(got[i] for i in range(100, 1100)) / 1000 < 2.5
    assert N.replicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("regime", ML.NETWORKS)
def test_network_regimes_score_raw_rows(spark, sf, regime):
    c = fx.comments(spark, sf)
    model, history = N.fit_network(regime, c, c, fx.word_vectors(spark, sf), (5, 5), ML.TrainConfig(positive_weight=1.5))
    p = ML.predict(model, c)
    assert p.count() == c.count() and p.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert M.auroc(p, score="score").first().auroc == pytest.approx(max(h.dev_auroc for h in history))
    with pytest.raises(ValueError):
        N.fit_network("ooc", c, c, fx.word_vectors(spark, sf), (5,))
