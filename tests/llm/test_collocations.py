import random
import re
from collections import Counter

import numpy as np
import pytest

from threadtox.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, word string, key int, n double, one long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2.0, 3) for i, (t, lang) in enumerate(rows)], SCHEMA)


def brute(rows, min_count=10, percent=50, top=2000, scale=10**6):
    runs = {}
    for text, lang in rows:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        f = runs.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            f.update(tuple(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, f in runs.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= min_count}
        scored = []
        for p, a in candidates.items():
            if len(p) == 2 and any(100 * c >= percent * a for q, c in candidates.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            s, k = min((scale * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def corpus():
    r = random.Random(5)
    words = [f"v{i}" for i in range(30)] + ["Über", "naïve", "中文"]
    rows = []
    for i in range(200):
        text = []
        for _ in range(r.randrange(1, 12)):
            text.append(" ".join(r.choices(words, [1 / (k + 1) for k in range(len(words))], k=r.randrange(1, 9))))
            if r.random() < 0.4:
                text.append(r.choice(["New York City", "hot phrase", "as well as", "in\tspite  of"]))
        rows.append((r.choice([". ", ", ", "\n", " ", "!? "]).join(text), ("en", "de", None, "")[i % 4 if i % 3 else 0]))
    return rows


AWKWARD = [(None, "en"), ("", "en"), (None, None), (" \t.\n!? ", "de"), ("alone", "xx"), ("a b c " * 5000 + "z" * 50_000, "long")] + [("ties a. ties b. ties c", "tie")] * 12


@pytest.mark.parametrize("options", [
    {}, {"budget": 50, "flush": 300}, {"max_words": 7, "budget": 100}, {"min_count": 3, "top": 9, "percent": 80, "budget": 1 << 30}])
def test_rows_are_those_of_brute_force(spark, options):
    rows = corpus() + AWKWARD
    got = co.collocations(table(spark, rows), **options)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((c, "bigint") for c in ("a", "l", "r", "n", "score"))]
    want = brute(rows, **{k: v for k, v in options.items() if k in ("min_count", "top", "percent")})
    assert sorted(tuple(r) for r in got.collect()) == want and any(p.count(" ") == 2 for _, _, p, *_ in want)


def test_pieces_of_slices(spark, monkeypatch):
    monkeypatch.setattr(co, "SLICE", 200)
    monkeypatch.setattr(co, "SUFFIX_SLICE", 90)
    rows = corpus()
    assert sorted(tuple(r) for r in co.collocations(table(spark, rows)).collect()) == brute(rows)


def test_scores_beyond_64_bits(spark):
    a, n = 3_000_000, 40
    df = spark.createDataFrame([(a * n, a * n + 1, a * n + 7)], "a long, f_one long, f_two long")
    from pyspark.sql import functions as F
    x, parts = F.col("a").cast("decimal(14,0)"), F.col("f_one").cast("decimal(19,0)") * F.col("f_two").cast("decimal(19,0)")
    got = df.select(F.call_function("div", x * x * F.lit(10**6).cast("decimal(7,0)"), parts)).first()[0]
    assert got == 10**6 * (a * n) ** 2 // ((a * n + 1) * (a * n + 7))


def test_groups_keep_to_the_budget():
    """Suffixes of a word within the budget share a group; leaves beyond it aside, no group holds more than 3 budgets."""
    r = np.random.default_rng(1)
    keys = r.choice(r.integers(1, 2**63, 40).astype(np.uint64), 20_000, p=np.array([0.5] + [0.5 / 39] * 39))
    piece = np.zeros(len(keys), dtype=np.int64)
    u, f = np.unique(keys, return_counts=True)
    p = co.Prefixes.pack(u, f, 600, True)
    at, one, two, three = p.suffixes(keys, piece)
    pairs, n = np.unique(co.pair_key(one, two), return_counts=True)
    p = p.extend(pairs[n > 600], n[n > 600], 600)
    group = p.route(at, one, two, three)
    assert len(p.deep) and group.max() < p.groups
    (leaf_group, *_), n = co.merged((group.astype(np.uint64), one, two, three), np.ones(len(group), dtype=np.int64))
    assert np.bincount(leaf_group.astype(int), n * (n <= 600)).max() <= 3 * 600
    cold = p.parts[at] == 1
    assert all(len(np.unique(group[cold & (one == k)])) == 1 for k in np.unique(one[cold]))


def test_empty_table(spark):
    assert co.collocations(table(spark, [])).collect() == []
