import pytest
from pyspark.sql import functions as F

from threadtox.operators import splits as S


def frame(spark, n, settings=("gc", "gn")):
    rows = [(i, s, i % 3 == 0 and 1 or 0) for i in range(n) for s in settings]
    return spark.createDataFrame(rows, "id long, setting string, label int")


@pytest.mark.parametrize("n", [1, 4, 5, 6, 399])
def test_mccv_exact_sizes(spark, n):
    st = S.mccv_split(frame(spark, n), splits=3, seed=42, test_size=0.2)
    import math
    val = math.ceil(0.2 * n)
    dev = min(val, n - val)
    sizes = {(r.setting, r.split, r.part): r["count"] for r in st.groupBy("setting", "split", "part").count().collect()}
    for setting in ("gc", "gn"):
        for split in range(3):
            assert sizes.get((setting, split, "val"), 0) == val
            assert sizes.get((setting, split, "dev"), 0) == dev
            assert sizes.get((setting, split, "train"), 0) == n - val - dev


def test_same_id_same_part_across_settings_and_partitionings(spark):
    df = frame(spark, 200)
    a = S.mccv_split(df, splits=4)
    b = S.mccv_split(df.repartition(5), splits=4, prefix_digits=1)
    pa = {(r.id, r.setting, r.split): r.part for r in a.collect()}
    pb = {(r.id, r.setting, r.split): r.part for r in b.collect()}
    assert pa == pb
    for (i, s, k), p in pa.items():
        assert pa[(i, "gc", k)] == pa[(i, "gn", k)]
    # different splits give different permutations
    assert [pa[(i, "gc", 0)] for i in range(200)] != [pa[(i, "gc", 1)] for i in range(200)]


def test_holdout_and_balance(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)], "id long, label int")
    h = S.holdout_split(df, test_size=0.1)
    assert h.where(F.col("part") == "dev").count() == 10
    b = S.balanced_downsample(df)
    assert {r.label: r["count"] for r in b.groupBy("label").count().collect()} == {0: 25, 1: 25}


def test_scan_split_reads_val_from_gc(spark):
    st = S.mccv_split(frame(spark, 50), splits=2)
    rows = S.scan_split(st, 1, "gn").collect()
    assert {(r.setting, r.part) for r in rows} == {("gn", "train"), ("gn", "dev"), ("gc", "val")}
    pooled = S.pooled_eval_set(st, 2)
    assert pooled.count() == pooled.select("id").distinct().count()


def test_prefix_digits_follow_row_count():
    assert S.prefix_digits_for(1000) == 3
    assert S.prefix_digits_for(1 << 18) == 3
    # 10^11 rows per key: 5 hex digits keep a (key, prefix) bucket near 2^18 rows
    d = S.prefix_digits_for(10 ** 11)
    assert d == 5 and 10 ** 11 / 16 ** d <= 1 << 18
