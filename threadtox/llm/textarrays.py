"""Word arrays: batches of texts as numpy arrays of word hashes, without a Python object per word.

Texts arrive as Arrow batches and are worked on in slices of about ``SLICE_BYTES``; word hashes are
computed over pieces of at most ``PIECE_BYTES``, so that a very long text needs a few words' worth of
memory per word and never a wide temporary per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
PIECE_BYTES = 1 << 17

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROLL = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.ones(1, dtype=np.uint64)

_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_UPPER = bytes(range(0x41, 0x5B))


def _table(separators: bytes, lower: bool) -> bytes:
    t = bytearray(range(256))
    if lower:
        for b in _UPPER:
            t[b] = b + 32
    for b in separators:
        t[b] = 0x20
    return bytes(t)


#: Words are runs without ASCII white space; A-Z lower-cased or kept.
WORDS_LOWER = _table(_SPACES, lower=True)
WORDS_AS_IS = _table(_SPACES, lower=False)
#: Words are runs of digits, letters and non-ASCII characters; A-Z lower-cased.
ALNUM_LOWER = _table(bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)),
                     lower=True)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(64, 1 << (n - 1).bit_length())
        p = np.full(size, _BASE, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.cumprod(p, dtype=np.uint64)
    return _POWERS


@dataclass
class Words:
    """The words of some texts: ``hashes`` and byte ranges in ``data``; text i has words first[i]:first[i+1]."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    offsets: np.ndarray  # where each text starts in data

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]]


def words_of(texts: list[bytes], table: bytes = WORDS_LOWER) -> Words:
    """The words of ``texts`` under a byte table that maps every separator to a space."""
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes + 1, out=offsets[1:])
    data = b" ".join(texts).translate(table) + b" "
    a = np.frombuffer(data, dtype=np.uint8)
    inside = a != 0x20
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(a) and inside[0]:
        change = np.concatenate([np.zeros(1, dtype=change.dtype), change])
    starts, ends = change[0::2], change[1::2]  # data ends with a space, so every word is closed
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE_BYTES)))
        hashes[at:to] = _hash(a, starts[at:to], ends[at:to])
        at = to
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets).astype(np.int64), offsets)


def _hash(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    piece = a[starts[0]:ends[-1]]
    chars = piece[piece != 0x20]
    lens = ends - starts
    off = np.cumsum(lens) - lens
    place = np.arange(len(chars)) - np.repeat(off, lens)
    v = _BYTE[chars] * _powers(int(lens.max()))[place]
    return mix(np.add.reduceat(v, off) + lens.astype(np.uint64) * _ROLL[63])


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``size``-word shingles, in text order, and where each text's begin.

    A text of fewer than ``size`` words, but not none, has its whole word sequence as one shingle.
    """
    n = words.counts
    full = np.maximum(n - size + 1, 0)
    out_n = np.where(full > 0, full, (n > 0).astype(np.int64))
    first = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(out_n, out=first[1:])
    h = words.hashes
    if len(h) >= size:
        rolled = np.zeros(len(h) - size + 1, dtype=np.uint64)
        for i in range(size):
            rolled += h[i:len(h) - size + 1 + i] * _ROLL[i]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, dtype=np.uint64)
    out = np.empty(int(first[-1]), dtype=np.uint64)
    at = np.arange(int(full.sum())) + np.repeat(words.first[:-1] - (np.cumsum(full) - full), full)
    to = np.arange(int(full.sum())) + np.repeat(first[:-1] - (np.cumsum(full) - full), full)
    out[to] = rolled[at]
    for i in np.flatnonzero((n > 0) & (full == 0)):
        own = h[words.first[i]:words.first[i + 1]]
        out[first[i]] = mix((own * _ROLL[:len(own)]).sum(dtype=np.uint64, keepdims=True) + np.array([len(own)], dtype=np.uint64) * _ROLL[62])[0]
    return out, first


def sliced(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[slice, list[bytes]]]:
    """Row ranges of ``batch`` of about ``limit`` bytes of text, with their texts as bytes (null: empty)."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(col.type):
        col = col.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, n = 0, len(sizes)
    total = np.cumsum(sizes)
    while at < n:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        part = col.slice(at, to - at)
        yield slice(at, to), [b"" if x is None else x for x in part.cast(pa.binary()).to_pylist()]
        at = to

