import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadtox.operators.ranking import exact_row_number, previous_value, running_totals


def _rows(n, keys, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.choice(keys), rnd.randrange(0, 50), rnd.random()) for i in range(n)]


def test_exact_row_number_matches_window(spark):
    df = spark.createDataFrame(_rows(500, ["a", "b", None]), "id long, k string, g long, v double")
    got = exact_row_number(df, ["k"], [F.col("g"), F.col("id")], [F.col("g")], name="rn", total="n")
    ref = df.withColumn("rn_ref", F.row_number().over(Window.partitionBy("k").orderBy("g", "id"))) \
        .withColumn("n_ref", F.count(F.lit(1)).over(Window.partitionBy("k")))
    j = got.join(ref.select("id", "rn_ref", "n_ref"), "id")
    assert j.count() == 500
    assert j.where((F.col("rn") != F.col("rn_ref")) | (F.col("n") != F.col("n_ref"))).count() == 0


def test_exact_row_number_global_and_stable_under_repartition(spark):
    df = spark.createDataFrame(_rows(300, ["x"]), "id long, k string, g long, v double")
    a = exact_row_number(df, [], [F.col("v")], [F.floor(F.col("v") * 16)], name="rn")
    b = exact_row_number(df.repartition(7), [], [F.col("v")], [F.floor(F.col("v") * 3)], name="rn")
    ra = {r.id: r.rn for r in a.collect()}
    rb = {r.id: r.rn for r in b.collect()}
    assert ra == rb
    assert sorted(ra.values()) == list(range(1, 301))


def test_running_totals_strictly_before(spark):
    df = spark.createDataFrame([(1, 5), (2, 7), (3, 1), (4, 2)], "o long, v long")
    out = running_totals(df, [], [F.col("o")], [F.col("o") >= 3], {"before": F.col("v")}, totals=True)
    got = {r.o: (r.before, r.total_before) for r in out.collect()}
    assert got == {1: (0, 15), 2: (5, 15), 3: (12, 15), 4: (13, 15)}


def test_previous_value_matches_lag(spark):
    rows = [(i * 3 + (i % 2), ["s1", "s2", "s3"][i % 3], f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "o long, k string, t string")
    got = previous_value(df, ["k"], "o", "t", out="prev", shift_bits=4)
    ref = df.withColumn("prev_ref", F.lag("t").over(Window.partitionBy("k").orderBy("o")))
    j = got.join(ref.select("o", "prev_ref"), "o")
    assert j.count() == 200
    assert j.where(~F.col("prev").eqNullSafe(F.col("prev_ref"))).count() == 0


def test_hot_thread_parent_and_topic_against_windows(spark):
    from threadtox.operators.context import thread_parent, thread_topic
    # one thread holds a third of all posts; turns are sparse integers
    rows = [("hot", i * 5 + 1, f"h{i}") for i in range(1000)]
    rows += [(f"c{i % 200}", i * 3 + 2, f"t{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, text string")
    w = Window.partitionBy("conv_id").orderBy("turn")
    ref = df.select("conv_id", "turn", F.lag("text").over(w).alias("p_ref"),
                    F.first("text").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                    .alias("t_ref"))
    got = thread_topic(thread_parent(df, shift_bits=4), out="topic")
    j = got.join(ref, ["conv_id", "turn"])
    assert j.count() == 3000
    assert j.where(~F.col("parent").eqNullSafe(F.col("p_ref")) | (F.col("topic") != F.col("t_ref"))).count() == 0
    # the hot thread is ranked in many (thread, turn >> 4) buckets, not in one task
    assert df.where(F.col("conv_id") == "hot").select(F.shiftright("turn", 4)).distinct().count() > 100


def test_previous_value_moves_each_value_once(spark):
    rows = [(i * 3, [None, "a", "b"][i % 3], f"t{i}" if i % 5 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "o long, k string, t string")
    got = previous_value(df, ["k"], "o", "t", out="prev", shift_bits=5)
    ref = df.withColumn("ref", F.lag("t").over(Window.partitionBy("k").orderBy("o"))).select("o", "ref")
    assert got.columns == ["o", "k", "t", "prev"] and got.join(ref, "o").where("prev <=> ref").count() == 100 == got.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") <= 3  # one with values, two of bucket ends
