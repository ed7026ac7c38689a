"""The pipeline's rows against the operators' brute-force versions, chained stage by stage over a small fixture."""

import math
from collections import Counter

import corpus_pipeline
import test_decontam
import test_dedup
import test_line_quality
import test_line_templates
import test_mixing
from helpers import docs, prose

LABELS = "doc_id long, quality int, toxic int"


def fixture():
    """Documents whose quality is plain from how they are made, with copies, near copies, shared lines and passages, and benchmark text."""
    rows, good = [], {}
    passage = prose(7000, 55, 3000)
    item = prose(8000, 30, 3000)

    def add(i, text, source, quality):
        rows.append((i, text, source))
        good[i] = quality

    for i in range(150):
        source = "hot" if i % 3 == 0 else f"s{i % 4}"
        if i % 5 == 0:
            add(i, test_line_quality.junk(i), source, 0)
            continue
        lines = test_line_quality.clean(i).split("\n")
        if i % 4 == 0:
            lines.insert(2, f"Posted in the forum by user{i} on day {i} of this year in our section.")
        if i % 7 == 0:
            lines.append("Share this page with all of your friends today.")
        if i in (31, 62):
            lines.append(passage + ".")
        if i in (41, 83):
            lines.append(" ".join(item.split()[5:20]) + ".")
        add(i, "\n".join(lines), source, 1)
    by = dict((r[0], r[1]) for r in rows)
    for k in range(12):
        add(300 + k, by[11], "hot", 1)  # enough copies for line dedup to take them
    for k in range(3):                  # too few for it: near dedup's
        add(400 + k, by[13].replace(by[13].split()[3 + k], f"edit{k}", 1), "s1", 1)
        add(450 + k, by[17], "hot", 1)
    add(500, "too short", "s2", 1)
    add(501, None, "s2", 1)
    add(502, "", None, 1)
    return rows, good, [(1, item), (2, "six words of an unseen item"), (3, None)]


def quotas(tokens, target=0.98, max_repeat=2.0):
    """Temperature mixing by plain bisection."""
    tokens = {s: n for s, n in tokens.items() if n}
    total = sum(tokens.values())

    def weights(a):
        w = {s: (n / total) ** a for s, n in tokens.items()}
        return {s: x / sum(w.values()) for s, x in w.items()}

    def entropy(a):
        return -sum(w * math.log(w) for w in weights(a).values())

    def most(a):
        return max(total * w / tokens[s] for s, w in weights(a).items())

    def bisect(holds):
        lo, hi = 0.0, 1.0
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if holds(mid) else (lo, mid)
        return (lo + hi) / 2

    goal = target * math.log(len(tokens))
    a = 1.0 if entropy(1.0) >= goal else bisect(lambda x: entropy(x) >= goal)
    if most(a) > max_repeat:
        a = max(a, bisect(lambda x: most(x) > max_repeat))
    return {s: math.floor(total * w + 1e-6) for s, w in weights(a).items()}


def test_rows_are_those_of_brute_force(spark, tmp_path):
    rows, good, items = fixture()
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in good.items() if i < 120], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    source = {r[0]: r[2] for r in rows}
    # the quality rules: what the base rules reject, and what is junk by the way it is made
    left = [(i, t) for i, t, _ in rows if not test_line_quality.brute(t)[-1] and good[i]]
    assert len(rows) - len(left) > 30 and {500, 501, 502}.isdisjoint(i for i, _ in left)
    deduped = [(i, t) for i, t in test_line_templates.brute(left) if t.split()]
    assert dict(deduped) != dict(left) and sum("Posted in" in t for _, t in deduped) == 1 and sum(t.count(prose(7000, 55, 3000)) for _, t in deduped) == 1
    near = [d for d, r in zip(deduped, test_dedup.brute(deduped, 80), strict=True) if r[3]]
    assert len(deduped) - len(near) == 6
    clean = [d for d, r in zip(near, test_decontam.brute(near, items), strict=True) if not r[5]]
    assert {41, 83} == {i for i, _ in near} - {i for i, _ in clean}
    tokens = Counter()
    for i, t in clean:
        tokens[source[i] or ""] += len(t.split())
    want = test_mixing.brute([(i, t, source[i]) for i, t in clean], quotas(tokens), 1, 1000)

    got = corpus_pipeline.run(spark, str(tmp_path))
    assert test_mixing.result(got) == want and len(want) > 80
