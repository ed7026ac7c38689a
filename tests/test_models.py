from dataclasses import replace

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from threadtox.operators import metrics as M
from threadtox.operators import models as ML
from threadtox.operators import splits as S
from threadtox.operators.stages import LearntVectors
from threadtox.session import scratch_path
from threadtox.sources import fixtures as fx

CFG = ML.TrainConfig(reg_param=0.05, max_iter=30, vocab_size=1 << 14)
# The planted-signal tests need a few hundred training rows to measure a regime: sf0.001 has ~50
# labelled comments in the training part, sf0.01 about 240.
SIGNAL_SF = "/root/testdata/sf0.01"


def signal(spark, sf, where):
    """Comments cut to 20 words, with a marker token added to ``where`` (text or parent) for toxic rows."""
    c = fx.comments(spark, sf)
    short = lambda col: F.substring_index(F.coalesce(F.col(col), F.lit("")), " ", 20)
    c = c.withColumn("text", short("text")).withColumn("parent", short("parent"))
    mark = F.when(F.col("label") == 1, F.lit(" zzbad")).otherwise(F.lit(""))
    return c.withColumn(where, F.concat(F.col(where), mark))


def fit_eval(spark, sf, where, regime, vec=None):
    c = signal(spark, sf, where)
    st = S.holdout_split(c, test_size=0.4, seed=1)
    train, test = st.where(F.col("part") == "train"), st.where(F.col("part") == "dev")
    model = ML.fit(regime, train, replace(CFG, augmented_vocabulary=where == "parent"), vec)
    return M.auroc(ML.predict(model, test), score="score").first().auroc


def test_text_signal_seen_by_context_free_model(spark):
    assert fit_eval(spark, SIGNAL_SF, "text", "ooc") > 0.9


def test_parent_signal_needs_context(spark):
    assert fit_eval(spark, SIGNAL_SF, "parent", "inc_concat") > 0.9
    assert fit_eval(spark, SIGNAL_SF, "parent", "inc_pair") > 0.9
    assert fit_eval(spark, SIGNAL_SF, "parent", "ooc") < 0.8


def test_parent_signal_seen_by_the_hybrid_model(spark):
    assert fit_eval(spark, SIGNAL_SF, "parent", "inc_hybrid", fx.word_vectors(spark, SIGNAL_SF)) > 0.9


def test_learnt_vectors_need_no_table(spark):
    assert fit_eval(spark, SIGNAL_SF, "parent", "inc_learnt") > 0.9


def _model_vocabulary(model):
    return [s.vocabulary for st in model.stages if isinstance(st, PipelineModel) for s in st.stages if hasattr(s, "vocabulary")]


@pytest.mark.parametrize("augmented", [False, True])
def test_a_word_of_parents_alone_has_weight_only_when_augmented(spark, augmented):
    rows = [(i, f"plain words {i % 3}", "onlyparent said" if i % 2 else "nothing here", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, parent string, label int")
    model = ML.fit("inc_concat", df, ML.TrainConfig(augmented_vocabulary=augmented, max_iter=20))
    target, context = _model_vocabulary(model)
    assert target == context and ("onlyparent" in target) == augmented and target[0] == ""
    n = len(target)
    at = [n + i for i, w in enumerate(context) if w == "onlyparent"]
    assert bool(at) == augmented and all(model.stages[-1].coefficients[i] > 0.1 for i in at)
    scores = {r.label: r.score for r in ML.predict(model, df).collect()}
    assert (scores[1] - scores[0] > 0.2) == augmented


def test_learnt_vectors_know_training_words_only(spark):
    train = spark.createDataFrame([(i, ["red", "green", "blue"][:1 + i % 3], 0) for i in range(30)], "id long, tt array<string>, n int")
    model = LearntVectors("tt", "v", size=4, min_count=1).fit(train)
    val = spark.createDataFrame([(1, ["red"]), (2, ["unseen"]), (3, []), (3, ["red", "unseen"])], "id long, tt array<string>")
    got = [(r.id, len(r.tt), r.v.toArray().tolist()) for r in model.transform(val).collect()]
    by = {k: v for *k, v in ([i, n, v] for i, n, v in got) for k in [tuple(k)]}
    assert by[2, 1] == by[3, 0] == [0.0] * 4 and any(by[1, 1]) and by[3, 2] == pytest.approx([x / 2 for x in by[1, 1]], abs=1e-6)
    empty = LearntVectors("tt", "v", size=4).fit(train.limit(0)).transform(val)
    assert {tuple(r.v.toArray()) for r in empty.collect()} == {(0.0,) * 4} and empty.count() == 4


@pytest.mark.parametrize("regime", ML.REGIMES + ML.NETWORKS)
def test_features_carry_no_metadata_in_the_executed_plan(spark, sf, regime):
    """Metadata of every feature would be part of each task of each optimiser iteration."""
    c = fx.comments(spark, sf)
    stages = Pipeline(stages=ML.feature_stages(regime, CFG, fx.word_vectors(spark, sf))).fit(c)
    features = stages.transform(c).select("id", "label", "weight", "features")
    assert len(features._jdf.queryExecution().executedPlan().schema().json()) < 10_000


def test_hybrid_pipeline_is_whole(spark, sf):
    """Saved and loaded, it scores (id, text, parent) alone, to the same scores; repeated and null ids keep their own."""
    c = fx.comments(spark, sf)
    model = ML.fit("inc_hybrid", c, ML.TrainConfig(positive_weight=2.0), fx.word_vectors(spark, sf))
    path = scratch_path(spark, "t-hybrid")
    model.write().save(path)
    again = PipelineModel.load(path)
    assert again.stages[0].getOrDefault("positiveWeight") == 2.0
    rows = c.select("id", "text", "parent").limit(20).unionByName(spark.createDataFrame(
        [(1, "twice", None), (1, "twice", "parent"), (1, None, ""), (None, "no id", "x"), (None, "", None)], "id long, text string, parent string"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    score = {m: sorted((str(r.id), r.text or "", r.parent or "", r.score) for r in ML.predict(m, rows, keep=("text", "parent")).collect()) for m in (model, again)}
    assert score[model] == score[again] and len(score[model]) == 25


def test_dev_selection_returns_the_best_model_of_the_grid(spark):
    c = S.holdout_split(signal(spark, SIGNAL_SF, "text"), test_size=0.4, seed=1)
    train, dev = c.where(F.col("part") == "train"), c.where(F.col("part") == "dev")
    model, history = ML.fit_with_dev_selection("ooc", train, dev, (1.0, 0.03), CFG, patience=3)
    again = M.auroc(ML.predict(model, dev), score="score").first().auroc
    assert abs(again - max(h[2] for h in history)) < 1e-12 and [h[:2] for h in history] == [(0, 1.0), (1, 0.03)]


def test_model_roundtrip_and_score_range(spark, sf):
    c = fx.comments(spark, sf)
    model = ML.fit("ooc", c, CFG)
    path = scratch_path(spark, "t-model")
    model.write().save(path)
    a = {r.id: r.score for r in ML.predict(model, c).collect()}
    b = {r.id: r.score for r in ML.predict(PipelineModel.load(path), c).collect()}
    assert a == b
    assert all(0.0 <= s <= 1.0 for s in a.values())


def test_select_best_patience(spark):
    t = spark.createDataFrame([(0, 0.6), (1, 0.7), (2, 0.65), (3, 0.69), (4, 0.9), (5, 0.95)],
                              "candidate int, metric double")
    r = ML.select_best(t, patience=2).first()
    assert (r.best_candidate, r.best_metric, r.stopped_at, r.evaluated) == (1, 0.7, 3, 4)
    r = ML.select_best(t, patience=3).first()
    assert (r.best_candidate, r.stopped_at) == (5, 5)


def test_hybrid_regime_fits(spark, sf):
    c = fx.comments(spark, sf)
    vec = fx.word_vectors(spark, sf)
    model = ML.fit("inc_hybrid", c, CFG, vec)
    p = ML.predict(model, c)
    assert p.count() == c.count()


def test_select_best_skips_missing_metric(spark):
    t = spark.createDataFrame([(0, 0.6), (1, None), (2, 0.7)], "candidate int, metric double")
    r = ML.select_best(t, patience=3).first()
    assert (r.best_candidate, r.best_metric, r.evaluated) == (2, 0.7, 3)


def test_fitted_terms_hand_their_words_over_at_once(spark, monkeypatch):
    from pyspark.ml.feature import CountVectorizerModel

    from threadtox.operators.stages import NO_WORD, FittedTerms
    rows = [(["b", "a", "é x", "b"],), (["", "a中\U0001f600", "b"],)]
    df = spark.createDataFrame(rows, "t array<string>")
    words = [NO_WORD, "b", "a", "a中\U0001f600", "é x"]
    with monkeypatch.context() as m:
        m.setattr(CountVectorizerModel, "_new_java_array", lambda *a: pytest.fail("a call a word"))
        model = FittedTerms(["t"], ["f"], ["t"], 10).fit(df.select(F.filter("t", lambda x: x != "").alias("t")))
    assert model.stages[0].vocabulary == words and model.stages[0].getVocabSize() == len(words)
    assert [r.f.indices.tolist() for r in model.transform(df.select(F.filter("t", lambda x: x != "").alias("t"))).collect()] == [[1, 2, 4], [1, 3]]
    odd = FittedTerms(["t"], ["f"], ["t"], 10).fit(spark.createDataFrame([(["x\ny", "z"],)], "t array<string>"))
    assert odd.stages[0].vocabulary == [NO_WORD, "x\ny", "z"]


def test_featurised_rows_are_written_and_never_in_more_partitions_than_cores(spark, monkeypatch):
    monkeypatch.setattr(ML, "ROWS_PER_TASK", 1)
    cores = spark.sparkContext.defaultParallelism
    rows = spark.createDataFrame([(i, f"word{i % 7}", None, i % 2) for i in range(10 * cores)], "id long, text string, parent string, label int") \
        .repartition(5 * cores)
    stages = Pipeline(stages=ML.feature_stages("ooc", CFG)).fit(rows)
    [own] = ML.featurised(stages, rows)
    assert own.count() == 10 * cores and own.rdd.getNumPartitions() <= cores
    [shared] = ML.featurised(stages, rows, together=3)
    assert shared.count() == 10 * cores and shared.rdd.getNumPartitions() <= -(-cores // 3)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "UDF" not in plan


def _two_words(spark):
    rows = spark.createDataFrame([(i, f"a{i % 5} b{i % 3}", None, i % 2) for i in range(40)], "id long, text string, parent string, label int")
    return rows.where("id < 30"), rows.where("id >= 30")


def test_candidates_are_fitted_side_by_side_and_walked_in_order(spark, monkeypatch):
    from threading import Barrier
    together = Barrier(4)
    by_reg = {1.0: 0.5, 0.3: 0.7, 0.1: 0.6, 0.03: 0.9}

    def metric(model, rows):
        together.wait(timeout=120)  # only all four at once get past
        return by_reg[model.getOrDefault("regParam")]

    monkeypatch.setattr(ML, "dev_auroc", metric)
    model, history = ML.fit_with_dev_selection("ooc", *_two_words(spark), tuple(by_reg), CFG, patience=1)
    assert history == [(0, 1.0, 0.5), (1, 0.3, 0.7), (2, 0.1, 0.6)]  # the better last one lies behind the stop
    assert model.stages[-1].getOrDefault("regParam") == 0.3


def test_optimisers_wait_for_room_on_the_driver(spark, monkeypatch):
    from threading import Lock
    monkeypatch.setattr(ML, "OPTIMISERS_MB", 0)
    lock, plain = Lock(), ML.LogisticRegression._fit

    def alone(self, rows):
        assert lock.acquire(blocking=False)
        try:
            return plain(self, rows)
        finally:
            lock.release()

    monkeypatch.setattr(ML.LogisticRegression, "_fit", alone)
    _, history = ML.fit_with_dev_selection("ooc", *_two_words(spark), (1.0, 0.1), CFG, patience=2)
    assert len(history) == 2 and ML._TAKEN == [0]


def test_the_vocabulary_is_cut_where_it_is_counted(spark, monkeypatch):
    """A sort with a limit would bring as many words from every partition to the driver."""
    from collections import Counter

    from pyspark.sql.classic.dataframe import DataFrame

    from threadtox.operators.stages import ranked_words
    words = [a + b for a in "abcdeé中\U0001f600" for b in ["", *"xyzé\U0001f600"]]
    rows = [([words[(i * 7 + j * j) % len(words)] for j in range(i % 9)],) for i in range(60)]
    df = spark.createDataFrame([*rows, (None,)], "t array<string>").repartition(4)
    want = [w for w, _ in sorted(Counter(w for r in rows for w in r[0]).items(), key=lambda x: (-x[1], x[0].encode()))]
    plain = DataFrame.collect
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", lambda self: pytest.fail("words as rows") if "word" in self.columns else plain(self))
        for size in (0, 1, 7, 20, len(want) - 1, len(want), len(want) + 3):
            assert ranked_words(df, ["t"], size) == want[:size]
    assert ranked_words(df.limit(0), ["t"], 5) == []


def test_fits_share_the_drivers_heap_and_leave_no_rows_behind(spark, monkeypatch):
    from pathlib import Path
    from threading import Lock

    from threadtox.session import ensure_checkpoint_dir
    scratch = Path(ensure_checkpoint_dir(spark).split(":", 1)[-1])
    before = set(scratch.glob("threadtox-*"))
    monkeypatch.setattr(ML, "driver_bytes", lambda spark: 1000)  # a heap that has room for one
    lock, plain = Lock(), ML.LogisticRegression._fit

    def alone(self, rows):
        assert lock.acquire(blocking=False)
        try:
            return plain(self, rows)
        finally:
            lock.release()

    monkeypatch.setattr(ML.LogisticRegression, "_fit", alone)
    model, history = ML.fit_with_dev_selection("ooc", *_two_words(spark), (1.0, 0.1), CFG, patience=2)
    assert len(history) == 2 and ML._TAKEN == [0]
    assert set(scratch.glob("threadtox-*")) == before and ML.predict(model, _two_words(spark)[1]).count() == 10
