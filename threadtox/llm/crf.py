"""Linear-chain conditional random field with two labels, in numpy.

A sequence is a run of rows of a feature matrix. Label 1 scores ``x @ w``, label 0 scores 0; ``start`` and
``step`` hold the scores of a first label and of label pairs. Training maximises the conditional likelihood
(forward-backward, Adam, L2), decoding is Viterbi; both walk all sequences of a batch at once, place by place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    w: np.ndarray       # (features,)
    start: np.ndarray   # (2,)
    step: np.ndarray    # (2, 2): from, to


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length: their first rows, lengths, and how many reach each place."""
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    lens = lengths[order]
    active = np.searchsorted(-lens, -np.arange(int(lens[0]) if len(lens) else 0), side="left")
    return first[order], lens, active


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def viterbi(chain: Chain, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best label of every row; of equally good ones label 1."""
    lengths = np.asarray(lengths, dtype=np.int64)
    emit = np.zeros((len(x), 2))
    emit[:, 1] = x @ chain.w
    labels = np.zeros(len(x), dtype=np.int64)
    first, lens, active = _layout(lengths)
    if not len(lens):
        return labels
    best = chain.start + emit[first]
    back = np.zeros((len(x), 2), dtype=np.int8)
    final = np.zeros((len(first), 2))
    for t, n in enumerate(active):
        if t:
            via = best[:n, :, None] + chain.step
            back[first[:n] + t] = (via[:, 1] >= via[:, 0]).astype(np.int8)
            best[:n] = via.max(axis=1) + emit[first[:n] + t]
        ends = np.flatnonzero(lens[:n] == t + 1)
        final[ends] = best[ends]
    now = (final[:, 1] >= final[:, 0]).astype(np.int64)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        labels[first[:n] + t] = now[:n]
        now[:n] = back[first[:n] + t, now[:n]]
    return labels


def fit(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, epochs: int = 120, rate: float = 0.1, l2: float = 1e-4) -> Chain:
    """Train on labelled sequences; without any row the chain calls everything label 1."""
    lengths = np.asarray(lengths, dtype=np.int64)
    n_features = x.shape[1]
    if not len(x):
        return Chain(np.zeros(n_features), np.array([0.0, 1.0]), np.array([[0.0, 1.0], [0.0, 1.0]]))
    first, lens, active = _layout(lengths)
    theta = np.zeros(n_features + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    y = np.asarray(y, dtype=np.int64)
    # what the labels themselves have of each parameter
    want = np.zeros_like(theta)
    want[:n_features] = x[y == 1].sum(axis=0)
    np.add.at(want, n_features + y[first], 1)
    inner = np.ones(len(x), dtype=bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    np.add.at(want, n_features + 2 + 2 * y[at - 1] + y[at], 1)
    for epoch in range(1, epochs + 1):
        w, start, step = theta[:n_features], theta[n_features:n_features + 2], theta[n_features + 2:].reshape(2, 2)
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ w
        alpha, beta = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        alpha[first] = start + emit[first]
        for t in range(1, len(active)):
            r = first[:active[t]] + t
            alpha[r] = _logsum(alpha[r - 1][:, :, None] + step, 1) + emit[r]
        for t in range(len(active) - 1, 0, -1):
            r = first[:active[t]] + t
            beta[r - 1] = _logsum(step + (emit[r] + beta[r])[:, None, :], 2)
        last = first + lens - 1
        z = np.zeros(len(x))
        z[np.concatenate([np.arange(f, f + n) for f, n in zip(first, lens, strict=True)])] = np.repeat(_logsum(alpha[last], 1), lens)
        p = np.exp(alpha + beta - z[:, None])
        have = np.zeros_like(theta)
        have[:n_features] = p[:, 1] @ x
        have[n_features:n_features + 2] = p[first].sum(axis=0)
        pair = np.exp(alpha[at - 1][:, :, None] + step + (emit[at] + beta[at])[:, None, :] - z[at][:, None, None])
        have[n_features + 2:] = pair.sum(axis=0).reshape(-1)
        grad = (have - want) / len(x) + l2 * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return Chain(theta[:n_features], theta[n_features:n_features + 2], theta[n_features + 2:].reshape(2, 2))
