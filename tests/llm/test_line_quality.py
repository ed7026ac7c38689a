import re
from collections import Counter

from helpers import awkward, docs, prose

from threadtox.llm import line_quality as lq

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover),
            len(w) < 50 or 100 * len(cover) > 50 * len(w))


def junk(i):
    return "\n".join(" | ".join(prose(i * 50 + k, 9).split()) + " |" for k in range(8))


def clean(i):
    return "\n".join(prose(i * 70 + k, 14).capitalize() + "." for k in range(8))


def base(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_counts_and_verdicts(spark):
    rows = [(i, clean(i) if i % 3 else junk(i)) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 0, 0), (61, None, 0)], LABELS)
    got = lq.quality(docs(spark, rows, extra=True), labels).collect()
    assert [base(r) for r in got] == [brute(t) for _, t in rows]
    assert all(r.kept == bool(r.doc_id % 3) for r in got if not r.base_failed) and not any(r.kept for r in got if r.base_failed)
    kept = lq.keep_good(docs(spark, rows, extra=True), labels)
    assert kept.columns == docs(spark, rows, extra=True).columns
    assert [r.doc_id for r in kept.collect()] == [r.doc_id for r in got if r.kept]


def test_most_words_decide(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], LABELS)
    train = docs(spark, [(i, clean(i) if i % 2 else junk(i)) for i in range(40)])
    chain = lq.train(train, labels)
    mixed = docs(spark, [(1, clean(90) + "\n" + clean(91) + "\n" + junk(92)), (2, clean(93) + "\n" + junk(94) + "\n" + junk(95) + "\n" + junk(96))])
    got = lq.judge(mixed, chain).collect()
    assert [r.kept for r in got] == [True, False] and 0 < got[1].content_share < 0.5 < got[0].content_share < 1


def test_awkward_rows(spark):
    labels = spark.createDataFrame([], LABELS)
    rows = [*awkward(), (20, clean(1)), (21, "a b c " * 40)]
    got = lq.quality(docs(spark, rows, extra=True), labels).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    assert [base(r) for r in got] == [brute(r[1]) for r in rows]
    assert got[-2].kept and not got[-1].kept  # without labels all lines are content; the base rules hold


def test_empty_tables(spark):
    assert lq.quality(docs(spark, []), spark.createDataFrame([], LABELS)).count() == 0
