import os

import numpy as np
import pytest

from threadtox.operators import inference as I


def features(spark, n=500, length=12):
    r = np.random.default_rng(2)
    rows = []
    for i in range(n):
        k = int(r.integers(0, length + 1))
        rows.append((i, [int(x) for x in r.integers(0, 5000, k)] + [0] * (length - k), [1] * k + [0] * (length - k), i / 10))
    return rows, spark.createDataFrame(rows, "id long, input_ids array<long>, input_mask array<long>, extra double").repartition(4)


def test_scores_are_those_of_direct_evaluation(spark):
    rows, df = features(spark)
    got = {r.id: (r.extra, r.score) for r in I.network_scores(df, I.bag_network_factory(), {"input_ids": [12], "input_mask": [12]}, keep=["extra"], batch_size=64).collect()}
    want = I.bag_network_factory()()(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    assert len(got) == 500 and all(got[r[0]][0] == r[3] and got[r[0]][1] == pytest.approx(w, abs=1e-12) for r, w in zip(rows, want))


def test_the_network_is_loaded_once_a_worker(spark, tmp_path):
    _, df = features(spark)
    folder = str(tmp_path)

    def make():
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write("x")
        return lambda ids: ids.sum(1).astype(float)

    scored = I.network_scores(df, make, {"input_ids": [12]}, batch_size=8)  # 4 partitions of some 16 batches
    for _ in range(2):
        scored.write.format("noop").mode("overwrite").save()
    loads = [len((tmp_path / p).read_text()) for p in os.listdir(folder)]
    assert loads and sum(loads) <= 8  # a load a task at most, not one a batch


def test_several_outputs_nulls_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 3.0), (2, None, 1.0), (3, [0.0, 1.0], None)], "id long, x array<double>, y double")
    one = {r.id: r.score for r in I.network_scores(df, lambda: (lambda x: x.sum(1)), {"x": [2]}).collect()}
    assert one == {1: 3.0, 2: None, 3: 1.0}
    two = {r.id: r.score for r in I.network_scores(df, lambda: (lambda x: np.stack([x.sum(1), x.max(1)], 1)), {"x": [2]}, outputs=2).collect()}
    assert two == {1: [3.0, 2.0], 2: None, 3: [1.0, 1.0]}
    assert I.network_scores(df.limit(0), lambda: (lambda x: x.sum(1)), {"x": [2]}).count() == 0
