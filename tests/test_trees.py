import pytest

from threadtox.operators import skew
from threadtox.operators import trees as T

SCHEMA = "id long, parent_id long, text string, depth string, root_id string"


def posts(spark, edges):
    return spark.createDataFrame([(i, p, f"text {i}", "x", "y") for i, p in edges], SCHEMA)


def brute(edges):
    up = {}
    for i, p in edges:
        if i is not None:
            up[i] = p if i not in up or up[i] is None else up[i] if p is None else min(up[i], p)
    out = []
    for i in up:
        at, depth, seen = i, 0, set()
        while up[at] is not None and up[at] in up and at not in seen:
            seen.add(at)
            at, depth = up[at], depth + 1
        cyclic = up[at] is not None and up[at] in up
        out.append((i, None if cyclic else at, None if cyclic else depth, up[i] is not None and up[i] not in up, cyclic))
    return sorted(out)


def tree(df):
    return sorted(tuple(r) for r in df.collect())


def test_long_chain_star_and_random_trees(spark):
    edges = [(i, i - 1 if i else None) for i in range(1000)]
    edges += [(2000 + i, 2000 if i else None) for i in range(900)]
    edges += [(5000 + i, 5000 + (i * 7919) % i if i else None) for i in range(300)]
    assert tree(T.reply_tree(posts(spark, edges).repartition(3))) == brute(edges)


def test_cycles_orphans_nulls_and_repeated_ids(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 6), (7, 99), (8, 7), (9, None), (10, 9), (None, 9), (None, None), (11, 9), (11, 9),
             (12, 10), (12, 9), (13, None), (13, 9)]
    want = brute(edges)
    assert tree(T.reply_tree(posts(spark, edges))) == want
    got = {r.id: (r.depth, r.orphan, r.cyclic) for r in T.reply_tree(posts(spark, edges)).collect()}
    assert got[5] == (None, False, True) and got[7] == (0, True, False) and got[8] == (1, False, False)
    assert T.reply_tree(posts(spark, [])).count() == 0


def test_parent_and_topic_texts(spark):
    edges = [(1, None), (2, 1), (3, 2), (4, 77), (None, 1), (2, 1)]
    df = posts(spark, edges)
    got = T.reply_parent(df)
    assert got.columns == [*df.columns, "parent_text"]
    assert sorted(((r.id or 0, r.parent_text) for r in got.collect()), key=str) == sorted(
        [(1, None), (2, "text 1"), (2, "text 1"), (3, "text 2"), (4, None), (0, "text 1")], key=str)
    assert sorted((r.id, r.topic) for r in T.reply_topic(df).collect()) == [(1, "text 1"), (2, "text 1"), (3, "text 1"), (4, "text 4")]


@pytest.mark.parametrize("share", [2, 1000])
def test_lookup_join_equals_a_join(spark, share):
    left = spark.createDataFrame([(i, 7 if i % 3 else (i if i % 2 else None)) for i in range(300)], "id long, k long")
    right = spark.range(0, 300, 2).selectExpr("id AS r", "id * 10 AS v").unionByName(spark.createDataFrame([(7, 70)], "r long, v long"))
    got = skew.lookup_join(left, right, "k", "r", share)
    want = left.join(right, left.k == right.r, "left").select("id", "k", "v")
    assert got.columns == ["id", "k", "v"] and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
