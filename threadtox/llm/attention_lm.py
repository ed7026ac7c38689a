"""Scores of texts under a causal self-attention model over subword ids, trained in numpy.

One pass over the texts packs them into chunks of a few MB: the distinct words as sorted 64-bit hashes, each
text as indexes into them, and each word's subword ids (a public vocabulary's merges, rank by rank). All later
steps read these packed columns.

* Word counts: every chunk's (hash, count) pairs are cut by hash into buckets, the buckets summed over all
  chunks, and each chunk gets the totals of its own words back. A bucket holds about ``bucket`` entries at any
  input size, and a word of any frequency is one entry a chunk.
* Model: subword ids fall into ``FINE`` classes of about equal training mass (word ends apart from the rest),
  four of which make one output class. P(id | before) = P(class | before) * P(id | class): the first factor is
  one causal self-attention layer (embedding, learned bias by distance, residual, softmax over classes), the
  second the id's share of its class in the training texts, add-one smoothed.
* Training: one pass over all windows of all training texts, laid out as in scoring, so each training id is a
  target once, however the text is cut into rows. The texts are spread by hash over ``rounds`` rounds of parameter
  averaging; in a round every chunk takes Adam steps from the shared parameters over its windows, in a fixed random
  order, and the chunks' means, weighted by windows, are the next shared parameters.
* Scoring: windows of two blocks of ``BLOCK`` ids, overlapping by one block, predict the ids of their second
  block; so each id is scored once, with 16 to 31 ids before it (fewer at a text's start). All windows of a
  slice are one batched masked attention.

Defined results: a null or empty text has one token, its end. Rows are scored one by one whatever their id
(a null id counts as the empty text for the split), repeated rows alike and counted each. Very long texts are trained on and scored whole.
An empty table gives an empty result; without training texts nothing is known and all classes are equally likely. Other columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadtox.llm import textarrays as ta
from threadtox.llm.rows import arrow_map, materialize, typed
from threadtox.llm.token_counts import Vocabulary, merge_all

CHUNK_BYTES = 4 << 20
BLOCK = 16
WIDTH = 16          # of an embedding
FINE, COARSE = 256, 4
OUT = FINE // COARSE + 1            # output classes; the last one is the end of a text
BEGIN, PAD = FINE, FINE + 1         # input classes beside the fine ones
SPAN = 2 * BLOCK

_CHUNK = ("chunk string, ids array<long>, words array<long>, at binary, hashes binary, counts binary, piece_n binary, pieces binary, "
          "id_counts binary, n_unique long, n_train long, held array<boolean>")


def held_out(doc_id: int | None, modulus: int, remainder: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


# ---- packing

class Packer:
    """Packs texts; remembers the subwords of recent words (a matter of speed only)."""

    def __init__(self, v: Vocabulary, modulus: int, remainder: int, remember: int = 1_000_000):
        self.v, self.modulus, self.remainder, self.limit = v, modulus, remainder, remember
        self.seen: dict[int, bytes] = {}

    def pieces(self, w: ta.Words, unique: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Numbers and ids of the subwords of each distinct word."""
        keys = unique.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.seen]
        if len(self.seen) + len(new) > self.limit:
            self.seen, new = {}, list(range(len(keys)))
        for a in range(0, len(new), 1 << 15):
            part = np.array(new[a:a + (1 << 15)], dtype=np.int64)
            lo, hi = w.starts[first[part]], w.ends[first[part]]
            n = hi - lo
            place = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
            count, ids = merge_all(np.frombuffer(w.data, dtype=np.uint8)[place], n, self.v)
            flat, at = ids.astype(np.uint16).tobytes(), np.concatenate([[0], np.cumsum(count)]).tolist()
            self.seen.update((keys[i], flat[2 * at[j]:2 * at[j + 1]]) for j, i in enumerate(part.tolist()))
        own = [self.seen[k] for k in keys]
        return np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 2, b"".join(own)

    def pack(self, name: str, ids: list[int | None], texts: list[bytes]) -> list:
        w = ta.words_of(texts)
        unique, first, at = np.unique(w.hashes, return_index=True, return_inverse=True)
        held = np.array([held_out(i, self.modulus, self.remainder) for i in ids], dtype=bool)
        train = np.repeat(~held, w.counts)
        counts = np.bincount(at[train], minlength=len(unique))
        n, flat = self.pieces(w, unique, first)
        piece = np.frombuffer(flat, dtype=np.uint16)
        start = np.cumsum(n) - n
        id_counts = np.bincount(piece, weights=np.repeat(counts, n), minlength=0).astype(np.int64) if len(piece) else np.zeros(0, np.int64)
        some = np.flatnonzero(id_counts)
        return [name, ids, w.counts, at.astype(np.uint32).tobytes(), unique.tobytes(), counts.astype(np.uint32).tobytes(),
                n.astype(np.uint32).tobytes(), flat,
                np.stack([some, id_counts[some]]).astype(np.int64).tobytes(), len(unique), int((~held).sum()), held]


def _ragged(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs values[start:start + n], end to end."""
    return values[np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)]


def pack(docs: DataFrame, shared, modulus: int, remainder: int) -> DataFrame:
    held: list[Packer] = []

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if not held:
            held.append(Packer(shared.value, modulus, remainder))
        part, k, batch, texts, row = TaskContext.get().partitionId(), 0, None, None, None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for rows, texts in ta.sliced(batch, "text", CHUNK_BYTES):
                row = held[0].pack(f"{part}-{k}", ids[rows], texts)
                k += 1
                types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 6, pa.int64(), pa.int64(), pa.list_(pa.bool_())]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[c.split()[0] for c in _CHUNK.split(", ")])
        del batch, texts, row
        held.clear()
        pa.default_memory_pool().release_unused()  # the worker lives on beside the later steps

    from threadtox.session import ship_package

    ship_package(docs.sparkSession)
    return typed(docs, doc_id="long", text="string").mapInArrow(of, _CHUNK)


# ---- word counts

def totals(chunks: DataFrame, bucket: int) -> DataFrame:
    """(bucket, chunk, totals, n_tokens, n_types): training counts of a chunk's words; the sums once a bucket."""
    entries = chunks.agg(F.sum("n_unique")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, entries / bucket)))))

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            h = np.frombuffer(batch.column(1)[i].as_py(), dtype=np.uint64)
            c = np.frombuffer(batch.column(2)[i].as_py(), dtype=np.uint32)
            edge = np.searchsorted(h >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64)) if bits else np.array([0, len(h)])
            own = [b for b in range(2**bits) if edge[b] < edge[b + 1]]
            yield pa.RecordBatch.from_arrays([
                pa.array(own, pa.int64()), pa.array([batch.column(0)[i].as_py()] * len(own), pa.string()),
                pa.array([h[edge[b]:edge[b + 1]].tobytes() for b in own], pa.binary()),
                pa.array([c[edge[b]:edge[b + 1]].tobytes() for b in own], pa.binary())], names=["bucket", "chunk", "hashes", "counts"])

    def add(t: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in t["hashes"]]
        n = [len(b) for b in blobs]
        _, at = np.unique(np.concatenate(blobs), return_inverse=True)
        del blobs
        total = np.bincount(at, weights=np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint32) for x in t["counts"]])).astype(np.uint64)
        edge = np.concatenate([[0], np.cumsum(n)])
        once = [0] * (len(n) - 1)
        return pa.table({"bucket": t["bucket"], "chunk": t["chunk"],
                         "totals": pa.array([total[at[edge[i]:edge[i + 1]]].astype(np.uint64).tobytes() for i in range(len(n))], pa.binary()),
                         "n_tokens": pa.array([int(total.sum()), *once], pa.int64()), "n_types": pa.array([int((total > 0).sum()), *once], pa.int64())})

    flat = arrow_map(chunks.select("chunk", "hashes", "counts"), cut, "bucket long, chunk string, hashes binary, counts binary")
    return flat.groupBy("bucket").applyInArrow(add, "bucket long, chunk string, totals binary, n_tokens long, n_types long")


# ---- model

def classes_of(counts: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fine class of each id, and ln P(id | its output class), from training counts; ``last``: ids that end a word."""
    fine = np.zeros(len(counts), dtype=np.int64)
    half = FINE // 2
    for k, group in enumerate((np.flatnonzero(last), np.flatnonzero(~last))):
        order = group[np.lexsort((group, -counts[group]))]
        mass = counts[order] + 1e-3
        middle = np.cumsum(mass) - mass / 2
        fine[order] = k * half + np.minimum(half - 1, (middle / mass.sum() * half).astype(np.int64))
    out = fine // COARSE
    mass = np.bincount(out, weights=counts + 1, minlength=OUT)
    return fine, np.log((counts + 1) / mass[out])


@dataclass
class Model:
    """The attention layer; every array is a parameter."""

    embed: np.ndarray   # (FINE + 2, WIDTH)
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray     # (WIDTH, WIDTH)
    near: np.ndarray    # (SPAN,): score by distance
    to: np.ndarray      # (WIDTH, OUT)
    base: np.ndarray    # (OUT,)

    @classmethod
    def shapes(cls) -> list[tuple[int, ...]]:
        return [(FINE + 2, WIDTH), *[(WIDTH, WIDTH)] * 4, (SPAN,), (WIDTH, OUT), (OUT,)]

    @classmethod
    def of(cls, flat: np.ndarray) -> Model:
        flat, parts, at = flat.astype(np.float32), [], 0
        for s in cls.shapes():
            n = math.prod(s)
            parts.append(flat[at:at + n].reshape(s))
            at += n
        return cls(*parts)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in vars(self).values()], dtype=np.float64)

    @classmethod
    def fresh(cls, share: np.ndarray) -> Model:
        """Starts as the unigram model of the output classes."""
        rng = np.random.default_rng(5)
        parts = [rng.normal(0, 0.25 if len(s) > 1 and s[0] == s[1] else 0.1, s) for s in cls.shapes()]
        parts[5] = np.zeros(SPAN)
        parts[7] = np.log(share)
        return cls.of(np.concatenate([p.ravel() for p in parts]))


_AGO = np.arange(SPAN)[:, None] - np.arange(SPAN)[None, :]
_SEES = _AGO >= 0
_SEEN = np.where(_SEES, _AGO, SPAN)
#: Scores within this bound go to exp as they are; beyond it the largest is taken off first.
SMALL = 60


def _longest(rows: np.ndarray) -> float:
    """Largest norm of a row."""
    return float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max(initial=0)))


def _bias(near: np.ndarray, lo: int) -> np.ndarray:
    """Score by distance of the places from ``lo`` on (rows) to all places of a window; -inf: not seen."""
    return np.take(np.append(near, np.float32(-np.inf)), _SEEN[lo:])


def _grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places ordered by input class, the classes that occur, and where each one's places begin."""
    x = x.astype(np.uint16).ravel()
    count = np.bincount(x)
    own = np.flatnonzero(count)
    return np.argsort(x, kind="stable"), own, (np.cumsum(count) - count)[own]


def _by_class(groups: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sums of the rows (one a place) of each input class."""
    order, own, first = groups
    out = np.zeros((FINE + 2, rows.shape[1]), dtype=np.float32)
    out[own] = np.add.reduceat(np.take(rows, order, axis=0), first, axis=0)
    return out


def gradient(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, Model]:
    """Mean loss over the targets of windows (inputs x, output classes y of their last places, -1: none) and its gradient.

    Queries, keys and values depend on a place's class only: they are computed once a class and looked up, and their
    gradients summed by class before they meet the parameters. A value has a last column of ones, of padding all zeros,
    so the product with the exponentials gives their sum too and padding takes no part.
    """
    n, lo = len(x), SPAN - y.shape[1]
    to_q = m.query * np.float32(WIDTH**-0.5)
    q_of, k_of, v_of = m.embed @ to_q, m.embed @ m.key, np.ones((FINE + 2, WIDTH + 1), dtype=np.float32)
    v_of[:, :WIDTH] = m.embed @ m.value
    v_of[PAD] = 0
    last = np.ascontiguousarray(x[:, lo:])
    q, k, v = np.take(q_of, last, axis=0), np.take(k_of, x, axis=0), np.take(v_of, x, axis=0)
    s = q @ k.transpose(0, 2, 1)
    s += _bias(m.near, lo)
    if _longest(q_of) * _longest(k_of) + np.abs(m.near).max() > SMALL:
        s = np.where((x != PAD)[:, None, :] | np.eye(SPAN, dtype=bool)[lo:], s, -np.inf)
        s -= s.max(axis=2, keepdims=True)
    e = np.exp(s, out=s)
    mixed = (e @ v).reshape(-1, WIDTH + 1)
    part = 1 / np.maximum(mixed[:, WIDTH:], np.float32(1e-30))
    mixed = mixed[:, :WIDTH] * part
    h = mixed @ m.out
    h += np.take(m.embed, last.ravel(), axis=0)
    z = m.to.T @ h.T  # (OUT, places)
    z += m.base[:, None]
    if _longest(h) * _longest(m.to.T) + np.abs(m.base).max() > SMALL:
        z -= z.max(axis=0)
    place = np.flatnonzero(y.ravel() >= 0)
    goal = y.ravel()[place]
    hit = z[goal, place]
    p = np.exp(z, out=z)
    total = np.ones(OUT, dtype=np.float32) @ p
    count = max(1, len(place))
    loss = float((np.log(total[place]) - hit).sum() / count)
    p[goal, place] -= total[place]
    weight = np.zeros((len(total), 1), dtype=np.float32)
    weight[place, 0] = 1 / (count * total[place])  # p * weight: the gradient of z
    dh = p.T @ m.to.T
    dh *= weight
    h *= weight
    from_mixed = dh @ m.out.T
    dmixed = np.empty((len(dh), WIDTH + 1), dtype=np.float32)
    np.multiply(from_mixed, part, out=dmixed[:, :WIDTH])
    np.negative(np.einsum("ij,ij->i", dmixed[:, :WIDTH], mixed), out=dmixed[:, WIDTH])
    dmixed = dmixed.reshape(n, -1, WIDTH + 1)
    ds = dmixed @ v.transpose(0, 2, 1)
    ds *= e
    everywhere, own = _grouped(x), _grouped(last)
    dv = _by_class(everywhere, (e.transpose(0, 2, 1) @ dmixed[:, :, :WIDTH]).reshape(-1, WIDTH))
    dk = _by_class(everywhere, (ds.transpose(0, 2, 1) @ q).reshape(-1, WIDTH))
    dq = _by_class(own, (ds @ k).reshape(-1, WIDTH))
    dv[PAD] = 0
    embed = _by_class(own, dh)
    embed += dq @ to_q.T + dk @ m.key.T + dv @ m.value.T
    return loss, Model(embed, m.embed.T @ dq * np.float32(WIDTH**-0.5), m.embed.T @ dk, m.embed.T @ dv, mixed.T @ dh,
                       np.bincount(_AGO[lo:][_SEES[lo:]], weights=ds.sum(axis=0)[_SEES[lo:]], minlength=SPAN).astype(np.float32),
                       (p @ h).T, (p @ weight)[:, 0])


def training_windows(ids: list[int | None], held: np.ndarray, words: np.ndarray, at: np.ndarray, piece_n: np.ndarray, piece: np.ndarray,
                     fine: np.ndarray, rounds: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All windows of a chunk's training texts of round ``k``: inputs (windows, SPAN) and output classes (windows, BLOCK)."""
    edge = np.concatenate([[0], np.cumsum(words)])
    start = np.cumsum(piece_n) - piece_n
    chosen = [i for i in np.flatnonzero(~held) if zlib.crc32(f"round {ids[i]}".encode()) % rounds == k]
    per = np.array([int(piece_n[at[edge[i]:edge[i + 1]]].sum()) for i in chosen], dtype=np.int64)
    classes = fine[piece]
    for a, b in _runs(np.cumsum(per) // 1_000_000):  # texts in runs of about a million ids
        own = np.concatenate([at[edge[i]:edge[i + 1]] for i in chosen[a:b]])
        inputs, goals, _ = _blocks(_ragged(classes, start[own], piece_n[own]), per[a:b])
        some = np.random.default_rng(7).permutation(np.flatnonzero((goals >= 0).any(axis=1)))
        yield np.concatenate([inputs[some], inputs[some + 1]], axis=1), goals[some]


def local_steps(flat: np.ndarray, windows: Iterator[tuple[np.ndarray, np.ndarray]], rate: float, size: int = 128) -> tuple[np.ndarray, int]:
    """Parameters after one Adam pass over the windows, and the number of windows."""
    theta, m, v, t, n = flat.copy(), np.zeros_like(flat), np.zeros_like(flat), 0, 0
    step = np.empty_like(flat)
    for x, y in windows:
        n += len(x)
        for at in range(0, len(x), size):
            t += 1
            _, g = gradient(Model.of(theta), x[at:at + size], y[at:at + size])
            g = g.flat()
            m += 0.1 * (g - m)
            g *= g
            v += 0.01 * (g - v)
            np.sqrt(np.multiply(v, 1 / (1 - 0.99**t), out=step), out=step)
            step += 1e-8
            np.divide(m, step, out=step)
            step *= rate / (1 - 0.9**t)
            theta -= step
    return theta, n


def train(chunks: DataFrame, fine: np.ndarray, share: np.ndarray, rounds: int, rate: float) -> Model:
    sc = chunks.sparkSession.sparkContext
    packed = chunks.select("ids", "held", "words", "at", "piece_n", "pieces")

    def steps(shared, k: int, pace: float):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat, classes = shared.value
            total, n, batch = np.zeros(len(flat)), 0, None
            for batch in batches:
                for r in range(batch.num_rows):  # a chunk's windows are one worker's share of the round
                    ids, held, words = (batch.column(i)[r].as_py() for i in range(3))
                    at, piece_n, piece = (batch.column(i)[r].as_buffer() for i in range(3, 6))
                    theta, own = local_steps(flat, training_windows(
                        ids, np.array(held, dtype=bool), np.array(words, dtype=np.int64), np.frombuffer(at, dtype=np.uint32),
                        np.frombuffer(piece_n, dtype=np.uint32).astype(np.int64), np.frombuffer(piece, dtype=np.uint16), classes, rounds, k), pace)
                    total += theta * own
                    n += own
                    del at, piece_n, piece
            del batch
            pa.default_memory_pool().release_unused()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1), pa.int64()), pa.array(np.append(total, n))], names=["i", "v"])
        return of

    flat = Model.fresh(share).flat()
    for k in range(rounds):
        shared = sc.broadcast((flat, fine))
        rows = packed.mapInArrow(steps(shared, k, rate * (1 - k / rounds)), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        if rows:  # one row a parameter
            got = np.zeros(len(flat) + 1)
            got[[r.i for r in rows]] = [r.v for r in rows]
            flat = got[:-1] / got[-1]
        shared.unpersist()
    return Model.of(flat)


class Scorer:
    """Scores block sequences under a trained model."""

    def __init__(self, m: Model):
        self.x = m.embed.copy()
        self.q = (m.embed @ m.query) * np.float32(WIDTH**-0.5)
        self.k = m.embed @ m.key
        self.v = np.concatenate([m.embed @ m.value @ m.out, np.ones((FINE + 2, 1), np.float32)], axis=1).astype(np.float32)
        self.v[PAD] = 0  # padding takes no part
        self.bias = _bias(m.near, BLOCK)
        # no score of this model can overflow below this bound, else the largest is taken off first
        self.small = _longest(self.q) * _longest(self.k) + float(np.abs(m.near).max()) < SMALL
        self.to, self.base = np.ascontiguousarray(m.to.T), m.base[:, None]
        self.most = _longest(self.to), float(np.abs(m.base).max())

    def __call__(self, inputs: np.ndarray, goals: np.ndarray, rows: int = 256) -> np.ndarray:
        """ln P of each goal: inputs (blocks + 1, BLOCK) with a first block of padding, goals (blocks, BLOCK), -1: none.

        ``rows`` blocks are worked on at once, few enough for a core's cache.
        """
        out = np.empty(goals.shape, dtype=np.float32)
        for a in range(0, len(goals), rows):
            b = min(a + rows, len(goals))
            part = inputs[a:b + 1].reshape(-1)
            k, v = np.take(self.k, part, axis=0), np.take(self.v, part, axis=0)
            n = b - a
            k = np.lib.stride_tricks.as_strided(k, (n, SPAN, WIDTH), (BLOCK * k.strides[0], *k.strides))
            v = np.lib.stride_tricks.as_strided(v, (n, SPAN, WIDTH + 1), (BLOCK * v.strides[0], *v.strides))
            own = part[BLOCK:]
            s = np.take(self.q, own, axis=0).reshape(n, BLOCK, WIDTH) @ k.transpose(0, 2, 1)
            s += self.bias
            if not self.small:
                seen = np.lib.stride_tricks.as_strided(part, (n, 1, SPAN), (BLOCK * part.strides[0], 0, part.strides[0]))
                s = np.where(seen != PAD, s, np.float32(-1e30))  # else padding could be the largest
                s -= s.max(axis=2, keepdims=True)
            mixed = (np.exp(s, out=s) @ v).reshape(-1, WIDTH + 1)
            h = mixed[:, :WIDTH] / np.maximum(mixed[:, WIDTH:], np.float32(1e-30))
            h += np.take(self.x, own, axis=0)
            z = self.to @ h.T  # (OUT, places)
            z += self.base
            if _longest(h) * self.most[0] + self.most[1] > SMALL:
                z -= z.max(axis=0)
            goal = goals[a:b].reshape(-1)
            hit = z[goal, np.arange(len(goal))]
            lp = hit - np.log(np.ones(OUT, dtype=np.float32) @ np.exp(z, out=z))
            out[a:b] = np.where(goal >= 0, lp, 0).reshape(n, BLOCK)
        return out


def _blocks(seq: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lay texts of ``n`` classes each out as blocks: inputs (with a first padding block), goals, first blocks.

    A text is one block of padding, then its blocks; the goals of a padding block are none.
    """
    blocks = -(-(n + 1) // BLOCK) + 1
    first = np.cumsum(blocks) - blocks
    inputs = np.full((int(blocks.sum()) + 1) * BLOCK, PAD, dtype=np.int64)
    goals = np.full(int(blocks.sum()) * BLOCK, -1, dtype=np.int64)
    # block b predicts from inputs[b + 1] and the block before it
    place = np.arange(len(seq)) + np.repeat((first + 1) * BLOCK - (np.cumsum(n) - n), n)
    goals[place] = seq // COARSE
    goals[(first + 1) * BLOCK + n] = OUT - 1
    inputs[(first + 2) * BLOCK] = BEGIN
    inputs[place + BLOCK + 1] = seq
    return inputs.reshape(-1, BLOCK), goals.reshape(-1, BLOCK), first


def score(docs: DataFrame, vocabulary: str, modulus: int = 7, remainder: int = 2, rounds: int = 6, rate: float = 0.03,
          bucket: int = 2_000_000) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    sc = docs.sparkSession.sparkContext
    v = Vocabulary.load(vocabulary)
    last = np.zeros(int(max(v.merged.max(initial=0), v.last.max(), v.inner.max())) + 1, dtype=bool)
    last[v.last] = True
    for _ in range(64):  # a merge ends a word if its right part does
        done = last[v.pairs & 0xFFFFFFFF]
        if last[v.merged[done]].all():
            break
        last[v.merged[done]] = True
    chunks = materialize(pack(docs, sc.broadcast(v), modulus, remainder), "packed")

    def id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(last), dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                i, n = np.frombuffer(x.as_py(), dtype=np.int64).reshape(2, -1)
                total[i] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["id", "n"])

    counts = np.zeros(len(last), dtype=np.int64)
    for r in chunks.select("id_counts").mapInArrow(id_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n  # at most one row a vocabulary entry
    n_texts, n_chunks = chunks.agg(F.sum("n_train"), F.count("*")).first()
    n_texts, parts = n_texts or 0, max(1, n_chunks // 2)  # about two chunks a task of the scoring join, at any size of the table
    fine, within = classes_of(counts, last)
    share = np.bincount(fine // COARSE, weights=counts, minlength=OUT) + 1
    share[OUT - 1] = n_texts + 1
    model = train(chunks, fine, share / share.sum(), rounds, rate)

    known = materialize(totals(chunks, bucket), "totals")
    sums = known.agg(F.sum("n_tokens"), F.sum("n_types")).first()
    n_tokens, n_types = (sums[0] or 0) + n_texts, (sums[1] or 0) + (n_texts > 0)
    each = known.repartition(parts, "chunk").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "totals"))).alias("totals"))
    packed = chunks.select("chunk", "ids", "held", "words", "at", "piece_n", "pieces").repartition(parts, "chunk").join(each, "chunk", "left")
    shared = sc.broadcast((Scorer(model), fine, within))

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scorer, fine, within = shared.value
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for r in range(batch.num_rows):
            words = np.array(col["words"][r].as_py(), dtype=np.int64)
            at = np.frombuffer(col["at"][r].as_py(), dtype=np.uint32)
            total = b"".join(x["totals"] for x in col["totals"][r].as_py() or ())
            total = np.frombuffer(total, dtype=np.uint64).astype(np.float64)
            piece_n = np.frombuffer(col["piece_n"][r].as_py(), dtype=np.uint32).astype(np.int64)
            piece = np.frombuffer(col["pieces"][r].as_py(), dtype=np.uint16)
            edge = np.concatenate([[0], np.cumsum(words)])
            log = np.log10((total + 1) / (n_tokens + n_types + 1))
            end = np.log10((n_texts + 1) / (n_tokens + n_types + 1))
            start = np.cumsum(piece_n) - piece_n
            ln_within = np.concatenate([[0.0], np.cumsum(within[piece])])
            ln_within = ln_within[start + piece_n] - ln_within[start]
            base, n_known, lm = np.empty(len(words)), np.empty(len(words), np.int64), np.empty(len(words))
            classes = fine[piece]
            # texts in runs of about a million ids
            per = np.array([int(piece_n[at[edge[i]:edge[i + 1]]].sum()) for i in range(len(words))], dtype=np.int64)
            run = np.cumsum(per) // 1_000_000
            for a, b in _runs(run):
                own = at[edge[a]:edge[b]]
                border = edge[a:b + 1] - edge[a]
                base[a:b] = _sums(log[own], border) + end
                n_known[a:b] = _sums((total[own] > 0).astype(np.int64), border) + (n_texts > 0)
                seq = _ragged(classes, start[own], piece_n[own])
                inputs, goals, first = _blocks(seq, per[a:b])
                blocks = scorer(inputs, goals).sum(axis=1, dtype=np.float64)
                lm[a:b] = _sums(blocks, np.append(first, len(blocks))) + _sums(ln_within[own], border)
            n = len(words)
            yield pa.RecordBatch.from_arrays([
                pa.array(col["ids"][r].as_py(), pa.int64()), pa.array(col["held"][r].as_py(), pa.bool_()), pa.array(words + 1),
                pa.array(n_known), pa.array([n_tokens] * n, pa.int64()), pa.array(base), pa.array(lm / np.log(10))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return arrow_map(packed, of, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else []
    return zip(edge[:-1], edge[1:], strict=True)


def _sums(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of x[edge[i]:edge[i + 1]], each summed on its own so that equal texts get equal sums."""
    out = np.zeros(len(edge) - 1, dtype=x.dtype)
    some = np.flatnonzero(edge[1:] > edge[:-1])
    if len(some):
        out[some] = np.add.reduceat(x, edge[some])
    return out
