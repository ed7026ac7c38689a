import itertools

import numpy as np

from threadtox.llm import crf


def random_chain(rng, n):
    return crf.Chain(rng.normal(size=n), rng.normal(size=2), rng.normal(size=(2, 2)))


def total(c, x, y):
    s = c.start[y[0]] + sum(c.step[a, b] for a, b in itertools.pairwise(y))
    return s + sum(float(row @ c.w) for row, label in zip(x, y, strict=True) if label)


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(20):
        c = random_chain(rng, 3)
        lengths = rng.integers(0, 7, 5)
        x = rng.normal(size=(int(lengths.sum()), 3))
        got, at = crf.viterbi(c, x, lengths), 0
        for n in lengths:
            own = x[at:at + n]
            if n:
                best = max(itertools.product((0, 1), repeat=int(n)), key=lambda y: total(c, own, y))
                assert tuple(got[at:at + n]) == best
            at += n


def test_fit_learns_rows_and_runs():
    rng = np.random.default_rng(4)
    lengths = np.full(200, 12)
    y = np.concatenate([np.repeat(rng.integers(0, 2, 2), 6) for _ in range(200)])  # labels come in runs of six
    x = np.stack([np.ones(len(y)), y + rng.normal(0, 0.9, len(y))], axis=1)
    c = crf.fit(x[:1200], y[:1200], lengths[:100])
    chain = (crf.viterbi(c, x[1200:], lengths[100:]) == y[1200:]).mean()
    alone = ((x[1200:, 1] > 0.5) == y[1200:]).mean()
    assert chain > alone + 0.05


def test_without_rows_all_is_label_1():
    c = crf.fit(np.zeros((0, 2)), np.zeros(0), np.zeros(0))
    assert crf.viterbi(c, np.ones((3, 2)), np.array([2, 0, 1])).tolist() == [1, 1, 1]
    assert crf.viterbi(c, np.zeros((0, 2)), np.zeros(0)).tolist() == []
