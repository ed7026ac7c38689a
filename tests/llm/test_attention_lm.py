import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, docs, prose

from threadtox.llm import attention_lm as lm

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_base(rows):
    words = [(t or "").encode().lower().split() for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for own, h in zip(words, held, strict=True) if not h for w in [*own, "the end"])
    n, v = sum(c.values()), len(c)
    out = []
    for (i, _), own, h in zip(rows, words, held, strict=True):
        own = [*own, "the end"]
        out.append((i, h, len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)))
    return out


def check_base(got, rows):
    want = brute_base(rows)
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [w[:5] for w in want]
    assert np.allclose([r.base_score for r in got], [w[5] for w in want], rtol=1e-9)


def test_scores_and_learning(spark):
    # words of the second half of a line follow those of the first: there is something to learn from what stands before
    def text(i):
        return " ".join(f"{a} {a}{a}" for a in prose(i, 60, 12).replace("w", "k").split())
    rows = [(i, text(i)) for i in range(300)]
    df = docs(spark, rows, extra=True).repartition(3).sortWithinPartitions("doc_id")
    by_id = {i: t for i, t in rows}
    got = sorted(lm.score(df, PATH, rounds=6, bucket=50).collect(), key=lambda r: r.doc_id)
    check_base(got, [(r.doc_id, by_id[r.doc_id]) for r in got])
    plain = {r.doc_id: r.score for r in lm.score(df, PATH, rounds=0).collect()}
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and all(r.score > plain[r.doc_id] for r in held)


def test_awkward_rows(spark):
    rows = [*awkward(), (30, "same text here"), (31, "same text here")]
    got = lm.score(docs(spark, rows, extra=True).coalesce(1), PATH, rounds=1).collect()
    check_base(got, rows)
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)
    assert got[-1].score == got[-2].score and got[0].score == got[1].score == got[2].score
    assert lm.score(docs(spark, []), PATH, rounds=1).count() == 0


def test_all_held_out(spark):
    rows = [(i, "a b") for i in range(60) if lm.held_out(i, 7, 2)]
    check_base(lm.score(docs(spark, rows).coalesce(1), PATH, rounds=1).collect(), rows)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(8)
    flat = lm.Model.fresh(np.full(lm.OUT, 1 / lm.OUT)).flat()
    return lm.Model.of(flat + rng.normal(0, 0.3, len(flat)))


def direct(m, seq):
    """ln P of a text's classes, id by id: each sees its own block and the one before."""
    inputs, goals = [lm.BEGIN, *seq], [*(c // lm.COARSE for c in seq), lm.OUT - 1]
    out = []
    for t, goal in enumerate(goals):
        lo = max(0, (t // lm.BLOCK - 1) * lm.BLOCK)
        e = m.embed[inputs[lo:t + 1]].astype(np.float64)
        s = (e[-1] @ m.query) @ (e @ m.key).T * lm.WIDTH**-0.5 + m.near[np.arange(t - lo, -1, -1)]
        a = np.exp(s - s.max())
        h = e[-1] + (a / a.sum()) @ (e @ m.value) @ m.out
        z = h @ m.to + m.base
        out.append(z[goal] - z.max() - np.log(np.exp(z - z.max()).sum()))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_windows_score_each_id_once_as_direct_attention_does(model, small):
    rng = np.random.default_rng(2)
    n = np.array([0, 1, 15, 16, 17, 40, 100])
    seqs = [rng.integers(0, lm.FINE, k) for k in n]
    inputs, goals, first = lm._blocks(np.concatenate(seqs), n)
    scorer = lm.Scorer(model)
    scorer.small = small
    got = scorer(inputs, goals, rows=7)
    assert int((goals >= 0).sum()) == int((n + 1).sum())
    for i, seq in enumerate(seqs):
        own = got[first[i]:first[i + 1] if i + 1 < len(first) else None]
        assert np.allclose(own[1:].reshape(-1)[:n[i] + 1], direct(model, seq), atol=1e-4)
        assert not own.reshape(-1)[lm.BLOCK + n[i] + 1:].any()


def test_gradient_against_differences(model):
    rng = np.random.default_rng(6)
    x = rng.integers(0, lm.FINE, (3, lm.SPAN))
    x[0, :20] = lm.PAD
    y = np.where(x == lm.PAD, -1, rng.integers(0, lm.OUT, x.shape))
    flat = model.flat()
    _, g = lm.gradient(model, x, y)
    g = g.flat()
    for i in [*rng.integers(0, len(flat), 12), *np.argsort(-np.abs(g))[:12]]:
        step = np.zeros_like(flat)
        step[i] = 1e-2
        slope = (lm.gradient(lm.Model.of(flat + step), x, y)[0] - lm.gradient(lm.Model.of(flat - step), x, y)[0]) / 2e-2
        assert abs(slope - g[i]) < 2e-3


def test_probabilities_of_ids_sum_to_one():
    counts = np.arange(500) % 37
    fine, within = lm.classes_of(counts, np.arange(500) % 3 == 0)
    share = np.bincount(fine // lm.COARSE, weights=np.exp(within))
    assert np.allclose(share[share > 0], 1) and fine.max() < lm.FINE


@pytest.mark.parametrize("rounds", [1, 6])
def test_every_training_id_is_a_target_once(rounds):
    words = prose(4, 4000, 300).split()
    fine = np.arange(50_000) % lm.FINE
    packer = lm.Packer(lm.Vocabulary.load(PATH), 7, 2)

    def targets(texts):
        row = dict(zip([c.split()[0] for c in lm._CHUNK.split(", ")], packer.pack("c", list(range(len(texts))), [t.encode() for t in texts]), strict=True))
        at, n = np.frombuffer(row["at"], dtype=np.uint32), np.frombuffer(row["piece_n"], dtype=np.uint32).astype(np.int64)
        piece, edge = np.frombuffer(row["pieces"], dtype=np.uint16), np.concatenate([[0], np.cumsum(row["words"])])
        start = np.cumsum(n) - n
        seqs = [fine[lm._ragged(piece, start[at[a:b]], n[at[a:b]])] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        want = Counter()
        for seq, held in zip(seqs, row["held"], strict=True):
            if not held:
                want.update(zip([lm.BEGIN, *seq], [*(seq // lm.COARSE), lm.OUT - 1], strict=True))
        got = Counter()
        for k in range(rounds):
            for x, y in lm.training_windows(list(range(len(texts))), np.array(row["held"]), np.array(row["words"]), at, n, piece, fine, rounds, k):
                assert x.shape[1] == lm.SPAN and y.shape[1] == lm.BLOCK
                on = y >= 0
                got.update(zip(x[:, lm.BLOCK:][on].tolist(), y[on].tolist(), strict=True))
        assert got == want
        return sum(got.values())

    short = targets([" ".join(words[i:i + 20]) for i in range(0, 4000, 20)])
    whole = targets([" ".join(words), "", "one"])
    assert whole > 4000 and short > 3000


def test_gradient_of_last_block_against_differences(model):
    rng = np.random.default_rng(7)
    x = rng.integers(0, lm.FINE, (3, lm.SPAN))
    x[0, :lm.BLOCK] = lm.PAD
    y = rng.integers(0, lm.OUT, (3, lm.BLOCK))
    full = np.concatenate([np.full_like(y, -1), y], axis=1)
    (a, g), (b, h) = lm.gradient(model, x, y), lm.gradient(model, x, full)
    assert abs(a - b) < 1e-5 and np.allclose(g.flat(), h.flat(), atol=1e-5)


def peak(f, *args):
    tracemalloc.start()
    f(*args)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_a_step_and_a_slice_of_scoring_stay_near_a_cores_cache(model):
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, lm.FINE, (128, lm.SPAN)), rng.integers(0, lm.OUT, (128, lm.BLOCK))
    assert peak(lm.gradient, model, x, y) < 3.6e6
    inputs, goals = rng.integers(0, lm.FINE, (4097, lm.BLOCK)), rng.integers(0, lm.OUT, (4096, lm.BLOCK))
    assert peak(lm.Scorer(model), inputs, goals) < 8e6


@pytest.mark.parametrize("factor", [1, 12])
def test_gradient_and_scores_of_small_and_large_parameters(model, factor):
    m = lm.Model.of(model.flat() * factor)
    scorer = lm.Scorer(m)
    assert scorer.small == (factor == 1)
    rng = np.random.default_rng(10)
    n = np.array([40, 3])
    seqs = [rng.integers(0, lm.FINE, k) for k in n]
    inputs, goals, first = lm._blocks(np.concatenate(seqs), n)
    want = np.concatenate([direct(m, seq) for seq in seqs])
    got = scorer(inputs, goals)
    assert np.allclose(got[goals >= 0], want, rtol=1e-3, atol=1e-3)
    some = np.flatnonzero((goals >= 0).any(axis=1))
    loss, g = lm.gradient(m, np.concatenate([inputs[some], inputs[some + 1]], axis=1), goals[some])
    assert abs(loss + want.mean()) < 1e-3 * max(1, abs(want.mean()))
    assert all(np.isfinite(p).all() for p in vars(g).values()) and not g.embed[lm.PAD].any()


def test_tasks_of_the_scoring_join_follow_the_chunks(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 2_000)
    rows = [(i, prose(i, 60, 12)) for i in range(300)]
    got = lm.score(docs(spark, rows).coalesce(1), PATH, rounds=0)
    size = sum(len(t) for _, t in rows)
    assert got.rdd.getNumPartitions() >= size // 2_000 // 2
    check_base(sorted(got.collect(), key=lambda r: r.doc_id), rows)
