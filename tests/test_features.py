import pytest
from pyspark.sql import functions as F

from threadtox.functions.text import SPECIAL_TOKENS
from threadtox.operators import features as FE


def vocab(spark, words):
    rows = [(t, i) for i, t in enumerate(SPECIAL_TOKENS)] + [(w, i + 4) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "token string, token_id long")


def test_pair_features_invariants(spark):
    v = vocab(spark, ["a", "b", "c"])
    rows = [(1, ["a", "b", "c", "a", "b"], ["c", "c", "c"], 1), (2, ["a"], [], 0), (3, ["q", "a"], None, 1)]
    df = spark.createDataFrame(rows, "id long, ta array<string>, tb array<string>, label int")
    out = {r.id: r for r in FE.pair_features(df, v, "ta", "tb", 8).collect()}
    for r in out.values():
        assert len(r.input_ids) == len(r.input_mask) == len(r.segment_ids) == 8
        assert sum(r.input_mask) == sum(1 for x in r.input_ids if x != 0)
        assert r.is_real_example
    # budget 5: a keeps 3, b keeps 2 -> [CLS] a a a [SEP] b b [SEP]
    assert out[1].input_ids == [2, 4, 5, 6, 3, 6, 6, 3]
    assert out[1].segment_ids == [0, 0, 0, 0, 0, 1, 1, 1]
    # empty / null second text: single-sequence form, unknown token -> [UNK]
    assert out[2].input_ids == [2, 4, 3, 0, 0, 0, 0, 0] and out[2].segment_ids == [0] * 8
    assert out[3].input_ids[:4] == [2, 1, 4, 3]
    assert out[1].label_id == 1 and out[2].label_id == 0


def test_label_outside_list_fails(spark):
    df = spark.createDataFrame([(1, 7)], "id long, label int")
    with pytest.raises(Exception):
        df.select(FE.label_index(F.col("label"), [0, 1])).collect()


def test_binarize_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (0.6,), (0.4,)], "t double")
    assert [r.b for r in df.select(FE.binarize(F.col("t")).alias("b")).collect()] == [0, 2, 2, 1, 0]
