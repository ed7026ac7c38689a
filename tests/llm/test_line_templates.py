import re
from collections import defaultdict

import pytest
from helpers import awkward, docs, prose

from threadtox.llm import line_templates as lt


def brute(rows, depth=3, min_docs=5, min_share=80, lead_share=70, long_docs=2, long_tokens=50):
    """Each row's text after dropping, by walking all lines."""
    def tokens(line):
        return tuple(re.findall(r"[^\x20\x09-\x0D]+", line))

    def masked(line):
        return ["<*>" if re.search("[0-9]", t) else t for t in line]

    docs_of = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n") if i is not None else []:
            if tokens(line):
                docs_of[tokens(line)].add(i)
    leaf = {line: (len(line), tuple(masked(line)[:depth])) for line in docs_of}
    count = defaultdict(int)
    for line, d in docs_of.items():
        for p, t in enumerate(masked(line)):
            count[leaf[line], p, t] += len(d)
    template, holders = {}, defaultdict(set)
    for line, d in docs_of.items():
        t = tuple(x if p < depth or count[leaf[line], p, x] >= min_docs else "<*>" for p, x in enumerate(masked(line)))
        share = lead_share if len(t) > 1 and "<*>" not in t[:2] else min_share
        if 100 * sum(x != "<*>" for x in t) >= share * len(t):
            template[line] = t
            holders[t] |= d

    def stays(i, line):
        own, of = docs_of[line], holders.get(template.get(line), set())
        need = long_docs if len(line) >= long_tokens else min_docs
        return not (len(of) >= min_docs and i > min(of) or len(own) >= need and i > min(own))

    return [(i, text if i is None or text is None else "\n".join(x for x in text.split("\n") if not tokens(x) or stays(i, tokens(x)))) for i, text in rows]


def corpus():
    rows = []
    for i in range(40):
        lines = [prose(i * 3 + k, 12) for k in range(3)]
        lines.insert(1, f"Posted on the board by user{i} at 12:{i:02d} today in our forum section here")
        if i % 2:
            lines.append("Share this page with all of your friends")
        if i % 3 == 0:
            lines += ["Copyright notice of the owner", "Copyright notice of the owner"]
        if i < 4:
            lines.append("only four documents have this line")
        lines.append(f"Read more about {'cats' if i % 2 else 'dogs'} and much more on our page")
        rows.append((100 - i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_lines_are_those_of_brute_force(spark, limit):
    rows = corpus()
    got = lt.drop_templates(docs(spark, rows, extra=True), max_broadcast=limit)
    assert got.columns == docs(spark, rows, extra=True).columns
    want = brute(rows)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(want)
    text = dict(want)
    assert sum("Posted on" in t for t in text.values()) == 1 and "Posted on" in text[61]
    assert sum("only four" in t for t in text.values()) == 4
    assert all(dict(rows)[i].split("\n")[0] in t for i, t in want)


def test_awkward_rows(spark):
    rows = [*awkward(), *[(50 + i, "a hot line of all\n\n" + prose(i, 9)) for i in range(6)], (None, "a hot line of all"), (52, "a hot line of all")]
    got = lt.drop_templates(docs(spark, rows, extra=True), counts=True).collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted(brute(rows), key=str)
    assert {r.n_lines for r in got if r.text is None} == {0} and sum(r.n_dropped for r in got) == 6


def test_empty_table_and_no_python(spark):
    assert lt.drop_templates(docs(spark, [])).count() == 0
    plan = lt.drop_templates(docs(spark, corpus()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow|Cartesian", plan)


def _holders(spark, line, n, **options):
    rows = [(10 + i, f"{'first' if i else 'other'} own{'abcdefgh'[i]} line\n{line}") for i in range(n)]
    return [r.doc_id for r in lt.drop_templates(docs(spark, rows), **options).orderBy("doc_id").collect() if line in r.text.split("\n")]


def test_long_lines_that_are_only_alike_stay(spark):
    words = ["abcdefghij"[i % 10] + "klmnopqrst"[i // 10] for i in range(50)]
    rows = [(i, " ".join(words[:35] + [f"own{'abcdefgh'[i]}{'abcdefghijklmno'[k]}" for k in range(15)])) for i in range(2)]
    assert sorted((r.doc_id, r.text) for r in lt.drop_templates(docs(spark, rows)).collect()) == rows == brute(rows)


def test_white_space_makes_no_other_line(spark):
    line = "Copyright 2024 Example Inc."
    rows = [(i, f"own{'abcdefgh'[i]} words\n" + (line, line + " ", "\t" + line.replace(" ", "  "), line + "\r")[i % 4]) for i in range(6)]
    got = sorted((r.doc_id, r.text) for r in lt.drop_templates(docs(spark, rows)).collect())
    assert got == brute(rows) and [line in " ".join(t.split()) for _, t in got] == [True] + [False] * 5


def test_counts_replace_columns_of_their_names(spark):
    df = docs(spark, [(1, "a\nb"), (2, None)]).selectExpr("*", "'x' AS n_lines", "7 AS n_dropped")
    got = lt.drop_templates(df, counts=True)
    assert got.columns == [*docs(spark, []).columns, "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in got.collect()) == [(1, 2, 0), (2, 0, 0)]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_hot_lines_are_those_of_brute_force(spark, limit):
    rows = [(i, prose(i, 7) + ("\nthe one line of very many documents here" if i % 3 else f"\nseen by user{i} on the board today again now")) for i in range(300)]
    got = lt.drop_templates(docs(spark, rows + rows[:9]), max_broadcast=limit)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(brute(rows + rows[:9]))


@pytest.mark.parametrize("n", [2, 3, 4])
def test_long_passages_go_from_two_documents_on(spark, n):
    words = " ".join("abcdefghij"[i % 10] + "klmnopqrst"[i // 10] for i in range(60))
    assert _holders(spark, words, n) == [10]
    assert _holders(spark, " ".join(words.split()[:20]), n) == [10 + i for i in range(n)]


@pytest.mark.parametrize("line", ["Copyright 2024 Example Inc.", "Page 1 of 10", "Posted on 2024-01-02 by admin at 10:33", "2024"])
def test_unchanged_lines_with_digits_go(spark, line):
    assert _holders(spark, line, 6) == [10]
    assert _holders(spark, line, 4) == [10, 11, 12, 13]


def test_log_template_with_two_fields_of_seven_tokens(spark):
    rows = [(i, f"own{'abcdefgh'[i]}\nPosted on 2024-01-0{i} by admin at 10:3{i}\n{i}{i} of {i}7") for i in range(6)]
    got = [r.text.split("\n") for r in lt.drop_templates(docs(spark, rows)).orderBy("doc_id").collect()]
    assert [len(x) for x in got] == [3, 2, 2, 2, 2, 2] and all(x[-1] == f"{i}{i} of {i}7" for i, x in enumerate(got))
