import re
from collections import Counter, defaultdict

import pytest
from helpers import prose
from pyspark.sql import functions as F

from threadtox.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, g int, z string, term double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, "x", 2.0) for i, (t, lang, source) in enumerate(rows)], SCHEMA)


def brute(rows, min_docs, top, prior, scale):
    docs = defaultdict(list)
    for text, lang, source in rows:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        docs[lang or ""].append((source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)))
    out = []
    for lang, own in docs.items():
        df = Counter(t for _, terms in own for t in set(terms))
        kept = sorted(t for t in df if df[t] >= min_docs)
        count = defaultdict(Counter)
        for source, terms in own:
            count[source].update(t for t in terms if df[t] >= min_docs)

        def shares(c):
            n = sum(c.values()) + prior * len(kept)
            return {t: 1 + scale * (c[t] + prior) // n for t in kept}

        p = {s: shares(c) for s, c in count.items()}
        q = shares(sum(count.values(), Counter()))
        for s in count:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in count if o != s]
            term = [(-(p[s][t] - q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def corpus():
    rows = []
    for i in range(160):
        source = "hot" if i % 3 == 0 else f"s{i % 5}"
        rows.append((prose(i, 40, 60).upper() + f" only{chr(97 + i % 5)} tail", ("en", "de", None)[i % 3 if i % 7 else 0], source if i % 11 else None))
    rows += [rows[3]] * 20
    rows += [("Ünïcode ünïcode 中文 \U0001f600 a1b2_c^d`e", "en", "s1")] * 6
    rows += [(None, "en", "empty"), ("", "en", "empty"), ("a b c", "few", "x"), ("a d", "few", "y"), ("1 2 3", "none", "x"), (None, None, None)]
    rows += [("word " * 30_000 + "longest" * 20_000, "de", "long")] * 3
    return rows


@pytest.mark.parametrize("options", [(3, 50, 5, 10**9), (6, 4, 1, 1000), (30, 2, 5, 10**9), (1000, 5, 5, 10**9)])
def test_rows_are_those_of_brute_force(spark, options):
    rows = corpus()
    got = divergence.audit(table(spark, rows), *options)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, *options)


def test_shared_terms_of_pairs(spark):
    entries = [(1, t, g, 10 * g + t, 3) for t in range(6) for g in range(0, 40, 1 + t)]
    df = spark.createDataFrame(entries, "lang int, term int, g long, p long, z long").groupBy("term").agg(F.collect_list(F.struct("g", "p", "z")).alias("has"))
    want = divergence._shared_terms(df).groupBy("g", "h").sum("value").collect()
    assert {(r[0], r[1]): r[2] for r in want} == {
        (a, b): sum(abs(10 * (a - b)) - abs(10 * a + t - 3) - abs(3 - 10 * b - t) for t in range(6) if a % (1 + t) == 0 and b % (1 + t) == 0)
        for a in range(40) for b in range(a + 1, 40)}


def test_shares_beyond_64_bits(spark):
    rows = [(c, 10**15 + 7, 1000) for c in (0, 1, 9 * 10**9, 10**10, 10**14)]
    df = spark.createDataFrame(rows, "c long, total long, kept long")
    got = df.select("c", divergence._share(F.col("c"), F.col("total"), F.col("kept"), 5, 10**9).alias("p")).collect()
    assert {r.c: r.p for r in got} == {c: 1 + 10**9 * (c + 5) // (10**15 + 7 + 5000) for c, *_ in rows}


def test_empty_table(spark):
    assert divergence.audit(table(spark, [])).collect() == []
