import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadtox.operators import metrics as M


def brute_auc(labels, scores):
    pos = [s for s, l in zip(scores, labels) if l == 1]
    neg = [s for s, l in zip(scores, labels) if l == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def brute_delong(labels, scores):
    pos = np.array([s for s, l in zip(scores, labels) if l == 1])
    neg = np.array([s for s, l in zip(scores, labels) if l == 0])
    v10 = np.array([((neg < p).sum() + 0.5 * (neg == p).sum()) / len(neg) for p in pos])
    v01 = np.array([((pos > n).sum() + 0.5 * (pos == n).sum()) / len(pos) for n in neg])
    return v10.mean(), v10.var(ddof=1) / len(pos) + v01.var(ddof=1) / len(neg)


def frame(spark, labels, scores, key=None):
    rows = [(i, int(l), float(s), key) for i, (l, s) in enumerate(zip(labels, scores))]
    return spark.createDataFrame(rows, "id long, label int, score double, k string")


@pytest.mark.parametrize("labels,scores,expected", [
    ([0, 1, 0, 1], [0.5, 0.5, 0.5, 0.5], 0.5),
    ([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9], 1.0),
    ([1, 1, 0, 0], [0.1, 0.2, 0.8, 0.9], 0.0),
])
def test_auroc_hand_cases(spark, labels, scores, expected):
    a = M.auroc(frame(spark, labels, scores)).first()
    assert a.auroc == pytest.approx(expected)


def test_auroc_one_class(spark):
    df = frame(spark, [1, 1, 1], [0.1, 0.2, 0.3])
    assert M.auroc(df).first().auroc is None
    assert M.auroc(df, degenerate="one").first().auroc == 1.0


def test_auroc_random_against_brute_force(spark):
    rnd = random.Random(7)
    labels = [rnd.random() < 0.3 for _ in range(400)]
    scores = [round(rnd.random() * 0.6 + 0.4 * l * rnd.random(), 2) for l in labels]
    a = M.auroc(frame(spark, labels, scores)).first().auroc
    assert a == pytest.approx(brute_auc(labels, scores), abs=1e-12)


def test_auroc_by_group(spark):
    rnd = random.Random(3)
    rows = []
    for k in ("a", "b"):
        for i in range(100):
            l = int(rnd.random() < 0.4)
            rows.append((len(rows), l, rnd.random() + 0.2 * l, k))
    df = spark.createDataFrame(rows, "id long, label int, score double, k string")
    got = {r.k: r.auroc for r in M.auroc(df, ["k"]).collect()}
    for k in ("a", "b"):
        ls = [r[1] for r in rows if r[3] == k]
        ss = [r[2] for r in rows if r[3] == k]
        assert got[k] == pytest.approx(brute_auc(ls, ss), abs=1e-12)


def test_delong_against_brute_force(spark):
    rnd = random.Random(11)
    labels = [rnd.random() < 0.4 for _ in range(300)]
    scores = [round(rnd.random() + 0.3 * l, 2) for l in labels]
    r = M.auroc_ci(frame(spark, labels, scores)).first()
    auc, var = brute_delong(labels, scores)
    assert r.auroc == pytest.approx(auc, abs=1e-12)
    assert r.variance == pytest.approx(var, rel=1e-9)
    assert r.ci_low == pytest.approx(max(0.0, auc - M.Z_95 * math.sqrt(var)), abs=1e-9)


def test_binned_auc_equals_threshold_trapezoid(spark):
    rnd = random.Random(5)
    labels = [int(rnd.random() < 0.5) for _ in range(300)]
    scores = [min(1.0, max(0.0, rnd.random() * 0.8 + 0.3 * l)) for l in labels]
    n = 200
    th = [-1e-7] + [(i + 1) / (n - 1) for i in range(n - 2)] + [1 + 1e-7]
    P, N = sum(labels), len(labels) - sum(labels)
    tpr = [sum(1 for s, l in zip(scores, labels) if l == 1 and s > t) / P for t in th]
    fpr = [sum(1 for s, l in zip(scores, labels) if l == 0 and s > t) / N for t in th]
    ref = sum((fpr[i] - fpr[i + 1]) * (tpr[i] + tpr[i + 1]) / 2 for i in range(n - 1))
    got = M.auc_binned(frame(spark, labels, scores)).first().auc_binned
    assert got == pytest.approx(ref, abs=1e-12)


def test_threshold_metrics_zero_denominators(spark):
    df = frame(spark, [0, 0], [0.1, 0.2])
    r = M.threshold_metrics(df).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (0, 0, 2, 0)
    assert r.precision == 0.0 and r.recall == 0.0 and r.accuracy == 1.0


def test_paired_randomization_identical_systems(spark):
    rnd = random.Random(2)
    rows = [(i, int(rnd.random() < 0.5), rnd.random()) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, label int, a double").withColumn("b", F.col("a"))
    r = M.paired_randomization(df, "a", "b", replicates=20).first()
    assert r.delta == 0.0 and r.p_value == 1.0


def test_paired_randomization_detects_difference(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(300):
        l = int(rnd.random() < 0.5)
        rows.append((i, l, rnd.random() + 0.8 * l, rnd.random()))
    df = spark.createDataFrame(rows, "id long, label int, good double, bad double")
    r = M.paired_randomization(df, "good", "bad", replicates=50).first()
    assert r.delta > 0.2 and r.p_value == pytest.approx(1 / 51)


def test_mccv_summary_sem(spark):
    df = spark.createDataFrame([(0, 0.6), (1, 0.7), (2, 0.8)], "split int, auroc double")
    r = M.mccv_summary(df).first()
    assert r.mean == pytest.approx(0.7)
    assert r.sem == pytest.approx(np.std([0.6, 0.7, 0.8], ddof=1) / math.sqrt(3))


def test_score_buckets_keep_the_order_and_spread_crowded_scores(spark):
    import math
    import random
    r = random.Random(5)
    special = [0.0, -0.0, 5e-324, -5e-324, 1.0, -1.0, 2.0**60, 2.0**-60, float("inf"), float("-inf"), 1e308, -1e308]
    edges = [math.nextafter(2.0**k, d) for k in range(-30, 30) for d in (0, 10**9)] + [2.0**k for k in range(-30, 30)]
    values = sorted([*special, *edges, *[-e for e in edges], *[r.gauss(0, 4) for _ in range(2000)], *[r.uniform(0.001, 0.002) for _ in range(2000)]])
    df = spark.createDataFrame([(v,) for v in [*values, float("nan")]], "s double").coalesce(1)
    got = [x.b for x in df.select(M.score_bucket(F.col("s")).alias("b")).collect()]
    assert got == sorted(got)
    near_zero = {b for b, v in zip(got, values) if 0.001 <= v <= 0.002}
    assert len(near_zero) > 50 and len({b for b, v in zip(got, values) if 0.5 <= abs(v) <= 8}) > 200


def test_auroc_of_logits_and_of_crowded_scores(spark):
    import random
    r = random.Random(6)
    for make in (lambda: r.gauss(0, 5), lambda: r.uniform(0.001, 0.002), lambda: r.choice([0.0, -0.0, 1e-9, -3.0, 700.0])):
        rows = [(make(), int(r.random() < 0.4)) for _ in range(400)]
        pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        got = M.auroc(spark.createDataFrame(rows, "score double, label int"), [], score="score").first().auroc
        assert abs(got - want) < 1e-12


def test_poisson_draws():
    t = [int(x, 16) / 16 ** 8 for x in M.poisson_thresholds()]
    assert t[0] == pytest.approx(math.exp(-1), abs=1e-9) and t[1] == pytest.approx(2 * math.exp(-1), abs=1e-9) and t == sorted(t)


def _draws(seed, replicate, key):
    h = hashlib.md5(f"{seed}:{(replicate - 1) // 4}:{key}".encode()).hexdigest()[8 * ((replicate - 1) % 4):][:8]
    return sum(h >= t for t in M.poisson_thresholds())


def test_bootstrap_interval_is_that_of_repeated_rows(spark):
    r = random.Random(4)
    rows = [(i if i % 9 else None, k, round(r.random() + 0.4 * (i % 2), 1), i % 2) for k in ("a", "b") for i in range(60)]
    rows += [(1, "c", 0.5, 1), (2, "c", 0.1, 1), (3, "a", None, 1), (4, "a", 0.5, None)]
    df = spark.createDataFrame(rows, "id long, k string, score double, label int")
    got = {x.k: x for x in M.auroc_bootstrap(df, ["k"], replicates=50, seed=3).collect()}
    for k in ("a", "b"):
        aucs = []
        for rep in range(1, 51):
            own = [(s, y) for i, kk, s, y in rows if kk == k and s is not None and y is not None for _ in range(_draws(3, rep, "" if i is None else i))]
            pos, neg = [s for s, y in own if y == 1], [s for s, y in own if y == 0]
            aucs.append(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)))
        assert got[k].replicates == 50
        assert [got[k].ci_low, got[k].ci_high] == pytest.approx(list(np.percentile(aucs, [2.5, 97.5])), abs=1e-12)
        assert got[k].ci_low < got[k].auroc < got[k].ci_high
    assert (got["c"].auroc, got["c"].replicates, got["c"].ci_low) == (None, 0, None)
    whole = M.auroc_bootstrap(df, replicates=8).collect()
    assert len(whole) == 1 and whole[0].replicates == 8
    assert M.auroc_bootstrap(df.limit(0), ["k"], replicates=8).count() == 0


def test_bootstrap_agrees_with_the_delong_interval(spark):
    """Over 600 rows both intervals are those of a normal estimate: ends within a fifth of their width."""
    r = random.Random(9)
    df = spark.createDataFrame([(i, r.gauss(0.8 * (i % 3 == 0), 1.0), int(i % 3 == 0)) for i in range(600)], "id long, score double, label int")
    b, d = M.auroc_bootstrap(df, replicates=400).first(), M.auroc_ci(df).first()
    width = d.ci_high - d.ci_low
    assert b.ci_low < d.auroc < b.ci_high and abs(b.ci_low - d.ci_low) < width / 5 and abs(b.ci_high - d.ci_high) < width / 5
