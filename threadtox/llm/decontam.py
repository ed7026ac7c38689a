"""Benchmark decontamination by a prefix-filtered containment join.

A benchmark item is its windows of ``window`` consecutive words (an item of fewer words, but not none, is one
window). A document contains a window where the words stand one after another. As a set join with containment
1.0 a window must share all of its shingles with the document, so its prefix is one shingle, the rarest:

1. The shingles (up to ``size`` words) of the windows are counted over all documents.
2. Each window is posted under its rarest shingle, with the shingle's offset in the window.
3. The documents' shingles are joined with these postings. Position and length bounds (the window must begin at
   or after the first word and end by the last) drop candidates; the rest are verified word for word.

The windows go to the tasks as a broadcast of at most ``max_mb`` per block; a larger benchmark is split into
blocks by window hash, and the documents pass one block after another with their hits so far. No document is
shuffled, so neither frequent passages nor large copy groups meet in one task.

Defined results: null and empty texts have no words, no windows and no hits; very long ones are searched whole. Items with a null ``item_id``
cannot be named and are left out; repeated items count once. Rows of ``docs`` are judged one by one, whatever
their id. Empty tables give no rows, or rows without hits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadtox.llm import textarrays as ta
from threadtox.llm.rows import arrow_map, materialize, typed

SHINGLE = 3
_STATE = "doc_id long, text string, n_words long, hits array<long>, items array<long>"


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """(item_id, words, n): the distinct windows of each item, words joined by a space."""
    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, texts in ta.sliced(batch, "text"):
            w = ta.words_of(texts, ta.ALNUM_LOWER)
            ids = batch.column(0).slice(rows.start, rows.stop - rows.start).to_pylist()
            out = []
            for i, item in enumerate(ids):
                own = [w.word(k) for k in range(w.first[i], w.first[i + 1])]
                if own:
                    out += [(item, b" ".join(own[k:k + window]).decode("utf-8", "replace"), min(len(own), window))
                            for k in range(max(1, len(own) - window + 1))]
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.int64())],
                                                 names=["item_id", "words", "n"])

    return arrow_map(typed(items, item_id="long", text="string").filter("item_id IS NOT NULL"), of,
                     "item_id long, words string, n long").distinct()


@dataclass
class Block:
    """Windows as arrays: words' hashes and bytes, the items they come from, and what each is posted under."""

    words: list[bytes]
    hashes: list[np.ndarray]
    items: list[list[int]]
    size: int

    def __post_init__(self):
        self.n = np.array([len(h) for h in self.hashes], dtype=np.int64)
        self.sizes = sorted({min(self.size, int(x)) for x in self.n})
        self.grams = [_grams(h, min(self.size, len(h))) for h in self.hashes]
        self.known = np.unique(np.concatenate(self.grams)) if self.grams else np.zeros(0, np.uint64)
        self.width = int(self.n.max()) if len(self.n) else 0
        self.table = np.zeros((len(self.n), self.width), dtype=np.uint64)
        for i, h in enumerate(self.hashes):
            self.table[i, :len(h)] = h

    def post(self, counts: dict[int, int]) -> None:
        """Post each window under its rarest shingle; equally rare: the smaller hash, the earlier place."""
        best = [min((counts.get(int(g), 0), int(g), k) for k, g in enumerate(own)) for own in self.grams]
        order = sorted(range(len(best)), key=lambda i: best[i][1])
        self.under = np.array([best[i][1] for i in order], dtype=np.uint64)
        self.place = np.array([best[i][2] for i in order], dtype=np.int64)
        self.which = np.array(order, dtype=np.int64)
        self.grams = []


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for i in range(size):
        out += h[i:len(h) - size + 1 + i] * ta._ROLL[i]
    return ta.mix(out + np.uint64(size))


def _batch_grams(w: ta.Words, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each shingle size: the hashes at every word of the batch, and which of them lie within one text."""
    last = np.repeat(w.first[1:], w.counts)
    for size in sizes:
        if len(w.hashes) >= size:
            g = _grams(w.hashes, size)
            yield g, np.arange(len(g)) + size <= last[:len(g)]


def _isin(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(sorted_values, x)
    return sorted_values[np.minimum(at, len(sorted_values) - 1)] == x


def gram_counts(docs: DataFrame, shared) -> DataFrame:
    """(gram, n): how often each shingle of the block's windows stands in the documents."""
    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block = shared.value
        total = np.zeros(len(block.known), dtype=np.int64)
        for _, texts in ta.sliced(batch, "text"):
            w = ta.words_of(texts, ta.ALNUM_LOWER)
            for g, whole in _batch_grams(w, block.sizes):
                g = g[whole & _maybe(block, g)]
                g = g[_isin(block.known, g)]
                total += np.bincount(np.searchsorted(block.known, g), minlength=len(total))
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(block.known[some].view(np.int64)), pa.array(total[some])], names=["gram", "n"])

    return arrow_map(docs.select("text"), of, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _maybe(block: Block, g: np.ndarray) -> np.ndarray:
    """A bit table over the hashes' top bits: most shingles of the documents are dismissed by one look-up."""
    bits = getattr(block, "bits", None)
    if bits is None:
        shift = max(44, 64 - max(16, (len(block.known) * 16).bit_length()))
        bits = (np.zeros(1 << (64 - shift), dtype=bool), np.uint64(shift))
        bits[0][block.known >> bits[1]] = True
        block.bits = bits
    return bits[0][g >> bits[1]]


def find(w: ta.Words, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Where windows stand in a batch: first words (indexes into the batch's words) and windows."""
    starts, found = [], []
    text_of = np.repeat(np.arange(len(w.counts)), w.counts)
    for g, whole in _batch_grams(w, block.sizes):
        at = np.flatnonzero(whole & _maybe(block, g))
        lo, hi = np.searchsorted(block.under, g[at], "left"), np.searchsorted(block.under, g[at], "right")
        many = hi - lo
        at, lo = np.repeat(at, many), np.repeat(lo, many)
        post = lo + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        k = block.which[post]
        start = at - block.place[post]
        text = text_of[at]
        ok = (start >= w.first[text]) & (start + block.n[k] <= w.first[text + 1])  # position and length bounds
        start, k = start[ok], k[ok]
        for j in range(block.width):
            far = np.minimum(start + j, len(w.hashes) - 1)
            ok = (block.n[k] <= j) | (w.hashes[far] == block.table[k, j])
            start, k = start[ok], k[ok]
        starts.append(start)
        found.append(k)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, k = np.concatenate(starts), np.concatenate(found)
    exact = [w.data[w.starts[s]:w.ends[s + block.n[i] - 1]].split() == block.words[i].split() for s, i in zip(start, k, strict=True)]
    exact = np.array(exact, dtype=bool)
    return start[exact], k[exact]


def _pass(docs: DataFrame, shared) -> DataFrame:
    """Add a block's hits to each row: word places that lie in a window, and the items."""
    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for rows, texts in ta.sliced(batch, "text"):
            part = batch.slice(rows.start, rows.stop - rows.start)
            w = ta.words_of(texts, ta.ALNUM_LOWER)
            start, k = find(w, block)
            cover = np.zeros(len(w.hashes) + 1, dtype=np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + block.n[k], -1)
            hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            border = np.searchsorted(hit, w.first)
            text = np.searchsorted(w.first, start, "right") - 1
            items: list[set[int]] = [set() for _ in texts]
            for t, i in {*zip(text.tolist(), k.tolist(), strict=True)}:
                items[t].update(block.items[i])
            before = part.column(3).to_pylist()
            named = part.column(4).to_pylist()
            hits = [hit[border[i]:border[i + 1]] - w.first[i] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(w.counts),
                pa.array([np.union1d(h, b) if b else h for h, b in zip(hits, before, strict=True)], pa.list_(pa.int64())),
                pa.array([sorted(own.union(b or ())) for own, b in zip(items, named, strict=True)], pa.list_(pa.int64())),
            ], names=["doc_id", "text", "n_words", "hits", "items"])

    return arrow_map(docs, of, _STATE)


def blocks(items: DataFrame, window: int, size: int, max_mb: float) -> Iterator[Block]:
    """The benchmark's windows in blocks of at most about ``max_mb`` each, by window hash."""
    all_windows = materialize(windows_of(items, window), "windows")
    # a window's share of a block: its text twice, the hashes of its words and shingles, its item id
    mb = (all_windows.agg(F.sum(F.length("words") * 2 + F.col("n") * 40 + 200)).first()[0] or 0) / 1e6
    n = max(1, int(np.ceil(mb / max_mb)))
    for b in range(n):
        rows = all_windows.filter(F.pmod(F.xxhash64("words"), F.lit(n)) == b).collect()
        by: dict[str, list[int]] = {}
        for r in rows:
            by.setdefault(r.words, []).append(r.item_id)
        words = sorted(by)
        texts = [x.encode() for x in words]
        w = ta.words_of(texts, ta.ALNUM_LOWER)
        yield Block(texts, [w.hashes[w.first[i]:w.first[i + 1]] for i in range(len(texts))], [by[x] for x in words], size)


def spans(docs: DataFrame, items: DataFrame, window: int = 10, size: int = SHINGLE, max_mb: float = 64) -> DataFrame:
    """(doc_id, text, n_words, hits, items) for each row: word places inside windows, ids of the items."""
    sc = docs.sparkSession.sparkContext
    state = typed(docs, doc_id="long", text="string").select(
        "doc_id", "text", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("array<long>").alias("hits"),
        F.lit(None).cast("array<long>").alias("items"))
    for i, block in enumerate(blocks(items, window, size, max_mb)):
        if i:
            state = materialize(state, "hits")
        counts = {}
        if len(block.known):
            shared = sc.broadcast(block)
            counts = {r.gram % 2**64: r.n for r in gram_counts(state, shared).collect()}  # at most the block's shingles
            shared.unpersist()
        block.post(counts)
        state = _pass(state, sc.broadcast(block))
    return state


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs`` (doc_id, text).

    ``items_sha256`` is the hash of the item ids, sorted as strings and joined by commas (none: of nothing).
    """
    found = spans(docs, items, window, **options)
    named = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(named, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, size: int = SHINGLE, max_mb: float = 64) -> DataFrame:
    """``docs`` without the rows that contain a window; all columns stay. A filter by row: no shuffle, no key."""
    sc = docs.sparkSession.sparkContext

    def without(shared):
        def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for rows, texts in ta.sliced(batch, "text"):
                w = ta.words_of(texts, ta.ALNUM_LOWER)
                start, _ = find(w, shared.value)
                clean = np.ones(len(texts), dtype=bool)
                clean[np.searchsorted(w.first, start, "right") - 1] = False
                yield batch.slice(rows.start, rows.stop - rows.start).filter(pa.array(clean))
        return of

    for i, block in enumerate(blocks(items, window, size, max_mb)):
        if i:
            docs = materialize(docs, "clean")
        if len(block.known):
            shared = sc.broadcast(block)
            block.post({r.gram % 2**64: r.n for r in gram_counts(docs, shared).collect()})  # at most the block's shingles
            shared.unpersist()
            docs = arrow_map(docs, without(sc.broadcast(block)), docs.schema)
    return docs
