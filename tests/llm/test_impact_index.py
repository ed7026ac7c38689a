import math

import numpy as np
import pytest

from threadtox.llm import impact_index as ii

SCHEMA = "vec_id long, embedding array<float>, score string, rank double, impacts int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0, 2) for i, v in rows], SCHEMA)


def brute(rows, k, divisor):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [max(-2**24, min(2**24, math.floor(64 * float(np.float32(x))))) for x in v]
            best[i] = min(best.get(i, q), q)
    out = []
    for i, q in best.items():
        if i % divisor == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, r)), j) for j, r in best.items() if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def result(df):
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(tuple(r) for r in df.collect())


def gaussian(n, width, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width))
    return [[float(y) for y in v] for v in x / np.linalg.norm(x, axis=1)[:, None]]


@pytest.mark.parametrize(("block_rows", "batch"), [(4096, 512), (64, 7), (100, 512)])
def test_rows_are_those_of_brute_force(spark, block_rows, batch):
    rows = list(enumerate(gaussian(400, 16, 1)))
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # ties at the k-th place
    df = table(spark, rows)
    got = ii.top_k(df.filter("vec_id % 5 = 0"), df, k=6, block_rows=block_rows, batch=batch)
    assert result(got) == brute(rows, 6, 5)


def test_several_query_chunks(spark):
    rows = list(enumerate(gaussian(300, 8, 5)))
    wide = [(i, v + [0.0] * 20_000) for i, v in rows[:60]]  # 80 kB a query: two chunks of 1 MB and more
    df = table(spark, wide)
    assert result(ii.top_k(df, df, k=3, chunk_mb=1)) == brute([(i, v[:8]) for i, v in wide], 3, 1)


def test_awkward_rows(spark):
    rows = [(None, [1.0, 2.0]), (0, None), (1, [1.0, None]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, []), (6, [1.0]),
            (8, [0.5, -0.25, 3.0]), (8, [0.5, -0.5, 3.0]), (8, [0.5, -0.5, 3.0]), (9, [1e30, -1e30]), (10, [-1e30, 2.0]), (11, [0.0, 0.0])]
    df = table(spark, rows)
    assert result(ii.top_k(df.filter("vec_id % 2 = 0"), df)) == brute(rows, 20, 2)
    assert result(ii.top_k(df.filter("vec_id = 4"), df.filter("vec_id = 4"))) == []
    none = table(spark, [])
    assert result(ii.top_k(none, none)) == [] and result(ii.top_k(none, df)) == [] and result(ii.top_k(df, none)) == []


def test_adding_stops_on_proof_only():
    """Early stops happen on spread norms, and what they leave out is never among the best."""
    r = np.random.default_rng(3)
    v = (r.normal(size=(2000, 32)) * r.lognormal(0, 1.5, size=(2000, 1)) * 20).astype(np.int64)
    dims, impacts, ends, places = ii.segments(v)
    assert (np.diff(np.abs(impacts)) <= 0).all() and ends[-1] == np.count_nonzero(v)
    cells = {n: x.tobytes() for n, x in [("ids", np.arange(2000)), ("vectors", v.astype(np.int32)), ("dims", dims.astype(np.int32)),
                                         ("impacts", impacts.astype(np.int32)), ("ends", ends.astype(np.int64)), ("places", places.astype(np.int32))]}
    block = ii.Block(cells | {"width": 32})
    q, q_ids = v[::50], np.arange(0, 2000, 50)
    at, ids, score = ii.score(block, q, q_ids, np.full(len(q), -np.inf), 5, 0.2)
    assert len(at) < 0.2 * q.shape[0] * 2000
    best = ii.Best(len(q), 5)
    best.add(slice(0, len(q)), at, ids, score)
    exact = q @ v.T
    for i in range(len(q)):
        own = sorted((-s, j) for j, s in enumerate(exact[i].tolist()) if j != q_ids[i])[:5]
        assert list(zip(best.score[i].tolist(), best.ids[i].tolist())) == [(-s, j) for s, j in own]
