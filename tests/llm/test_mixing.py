import hashlib
import math
from collections import Counter, defaultdict

import pytest
from helpers import awkward, docs, prose

from threadtox.llm import mixing


def md5(*parts):
    return int(hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)


def brute(rows, quotas, seed, block_docs):
    """The drawn rows by walking each source's permutations."""
    own = defaultdict(list)
    for i, text, source in rows:
        own[source or ""].append((i, len((text or "").encode().split())))
    out = []
    for s, quota in quotas.items():
        if not quota:
            continue
        n, total = -(-len(own[s]) // block_docs), sum(k for _, k in own[s])
        for epoch in range(1, quota // total + 2):
            left = total if epoch <= quota // total else quota % total
            blocks = defaultdict(list)
            for i, k in own[s]:
                blocks[md5(seed, i) % n].append((md5(seed, epoch, i), -1 if i is None else i, k, i))
            for rank, b in enumerate(sorted(blocks, key=lambda b: (md5(seed, epoch, b), b)), 1):
                for place, (_, _, k, i) in enumerate(sorted(blocks[b], key=lambda x: x[:3]), 1):
                    left -= k
                    if left >= 0 and (epoch <= quota // total or quota % total):
                        out.append((i, s, epoch, rank, place, k))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.source, r.epoch, r.block_rank, r.place, r.n_tokens) for r in df.collect()), key=str)


def skewed():
    return [(i, prose(i, 5 + i % 40), "big" if i % 3 == 0 else f"s{i % 7}") for i in range(400)] + [(900 + i, prose(i, 30), "tiny") for i in range(4)]


@pytest.mark.parametrize("options", [{}, {"target_entropy": 1.0, "max_repeat": 3.0}, {"budget": 700}, {"budget": 60_000, "max_repeat": 1e9}])
def test_rows_are_those_of_brute_force(spark, options):
    rows = skewed()
    got = result(mixing.mix(docs(spark, rows, extra=True), block_docs=20, seed=3, **options))
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    m = mixing.solve(tokens, options.get("budget", sum(tokens.values())), options.get("target_entropy", 0.98), options.get("max_repeat", 2.0))
    assert got == brute(rows, m.quotas, 3, 20)
    drawn = Counter()
    for _, s, _, _, _, n in got:
        drawn[s] += n
    assert all(m.quotas[s] - 40 <= drawn[s] <= m.quotas[s] for s in drawn)


def test_bisection():
    tokens = {"a": 10_000, "b": 1000, "c": 100, "none": 0}
    flat = mixing.solve(tokens, 11_100, 0.9, 1e9)
    assert abs(mixing.entropy(flat.weights) - 0.9 * math.log(3)) < 1e-6 and 0 < flat.alpha < 1
    limited = mixing.solve(tokens, 11_100, 0.9, 2.0)
    assert abs(max(11_100 * w / tokens[s] for s, w in limited.weights.items()) - 2.0) < 1e-6 and limited.alpha > flat.alpha
    assert mixing.solve(tokens, 11_100, 0.0, 1e9).alpha == 1.0
    assert abs(mixing.solve(tokens, 11_100, 1.0, 1e9).alpha) < 1e-9
    assert mixing.solve({"a": 5}, 100, 0.98, 2.0).weights == {"a": 1.0}
    assert mixing.solve({}, 10, 0.9, 2).quotas == mixing.solve({"a": 0}, 10, 0.9, 2).quotas == {}


def test_awkward_rows(spark):
    rows = [(i, t, [None, "s", ""][k % 3]) for k, (i, t) in enumerate(awkward())]
    got = result(mixing.mix(docs(spark, rows, extra=True), block_docs=2))
    tokens = Counter()
    for _, t, s in rows:
        tokens[s or ""] += len((t or "").encode().split())
    assert {x[1] for x in got} == {s for s, n in tokens.items() if n}
    m = mixing.solve(tokens, sum(tokens.values()), 0.98, 2.0)
    want = brute(rows, m.quotas, 1, 2)
    assert Counter(x[:4] for x in got) == Counter(x[:4] for x in want)
    assert mixing.mix(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs(spark, rows), max_sources=1)
