import itertools
import random

import pytest
from helpers import awkward, docs, prose

from threadtox.llm import dedup


def brute(rows, percent=85):
    """(n_shingles, component_id) of each row by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    out = []
    for i, (doc, _) in enumerate(rows):
        c = None if doc is None else doc if not sets[i] else least[find(i)]
        out.append((doc, len(sets[i]), c, doc is None or doc == c))
    return out


def result(df):
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()]


def key(r):
    return str(r)


def variants(seed, n_words, copies, edits):
    """A text and copies of it with some words replaced; copies of copies drift further."""
    r = random.Random(seed)
    texts = [prose(seed, n_words, 3000)]
    for k in range(copies):
        w = r.choice(texts).split()
        for _ in range(r.randint(1, edits)):
            w[r.randrange(len(w))] = f"edit{seed}_{k}_{r.randrange(3)}"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("percent", [85, 80])
def test_groups_are_those_of_all_pairs(spark, percent):
    texts = [t for s in range(6) for t in variants(s, 60 + 40 * s, 14, 3)]
    texts += [prose(100 + i, 120) for i in range(20)] + ["short text", "Short TEXT", "a b c d e", "a b c d e f"]
    common = prose(77, 60)  # a passage that many documents share
    texts += [f"{common} {prose(500 + i, 55)}" for i in range(25)]
    texts += [texts[0]] * 30
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    got = result(dedup.near_duplicates(docs(spark, rows), percent=percent, match=28 if percent == 85 else 24))
    assert sorted(got, key=key) == sorted(brute(rows, percent), key=key)


def test_awkward_rows(spark):
    got = result(dedup.near_duplicates(docs(spark, awkward(), extra=True)))
    assert sorted(got, key=key) == sorted(brute(awkward()), key=key)


def test_empty_table(spark):
    assert result(dedup.near_duplicates(docs(spark, []))) == []
    assert dedup.keep_one_of_each(docs(spark, [])).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100 + i, 200) for i in range(50)] + [(150, 151)]
    got = dict(map(tuple, dedup.components(spark.createDataFrame(chain + star, "a long, b long")).collect()))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 150)} == {100} and got[200] == 100 and got[151] == 150


def test_keep_one_of_each_keeps_columns_and_other_texts_of_an_id(spark):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(3, a), (2, a), (2, a), (5, b), (5, prose(4, 50)), (None, a), (7, None)]
    left = dedup.keep_one_of_each(docs(spark, rows, extra=True))
    assert left.columns == docs(spark, rows, extra=True).columns
    assert sorted(map(key, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(key, [(2, a), (5, b), (5, prose(4, 50)), (None, a), (7, None)]))
