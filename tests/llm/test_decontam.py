import hashlib
import re

import pytest
from helpers import awkward, docs, prose

from threadtox.llm import decontam

ITEMS = "item_id long, text string"


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def brute(rows, items, size=10):
    wins = {}
    for item, text in items:
        w = words(text)
        if w and item is not None:
            for k in range(max(1, len(w) - size + 1)):
                wins.setdefault(tuple(w[k:k + size]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, named = words(text), set(), set()
        for win, own in wins.items():
            n = len(win)
            for k in range(len(w) - n + 1):
                if w[k] == win[0] and tuple(w[k:k + n]) == win:
                    hit.update(range(k, k + n))
                    named |= own
        ids = ",".join(sorted(map(str, named)))
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def cases():
    items = [(i, prose(i, 14 + i, 60)) for i in range(12)] + [(50, "Only four words, here"), (51, "one"), (52, ""), (53, None), (None, prose(3, 40)),
             (4, prose(4, 18, 60)), (54, "same same same same same same same same same same same same"), (55, prose(2, 16, 60)), (100, "w1x")]
    rows = [(i, prose(1000 + i, 80, 60)) for i in range(30)]
    rows += [(100 + i, f"{prose(i, 20)}\n{t}! {prose(i + 1, 20)}") for i, (_, t) in enumerate(items) if t]
    rows += [(200, prose(2, 15, 60).upper()), (201, "x " + " ".join(prose(2, 16, 60).split()[3:12])), (202, "ONLY-four words  here"),
             (203, "only four words"), (204, "same " * 25)]
    return rows, items


def result(df):
    return [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()]


@pytest.mark.parametrize("max_mb", [64, 0.01])
def test_hits_are_those_of_brute_force(spark, max_mb):
    rows, items = cases()
    got = result(decontam.contamination(docs(spark, rows, extra=True), spark.createDataFrame(items, ITEMS), max_mb=max_mb))
    assert sorted(got) == sorted(brute(rows, items))
    left = decontam.drop_contaminated(docs(spark, rows, extra=True), spark.createDataFrame(items, ITEMS), max_mb=max_mb)
    assert left.columns == docs(spark, rows, extra=True).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in brute(rows, items) if not r[5])


def test_awkward_rows(spark):
    items = [(1, "ties and"), (2, "中文 words")]
    got = result(decontam.contamination(docs(spark, awkward()), spark.createDataFrame([(*i, 1) for i in items], ITEMS + ", words int")))
    assert sorted(got, key=str) == sorted(brute(awkward(), items), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    rows = [(1, "some words"), (2, None)]
    assert sorted(result(decontam.contamination(docs(spark, rows), none))) == sorted(brute(rows, []))
    assert decontam.drop_contaminated(docs(spark, rows), none).count() == 2
    assert decontam.contamination(docs(spark, []), spark.createDataFrame([(1, "a b")], ITEMS)).count() == 0
