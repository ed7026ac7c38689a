"""Token counts by rank-synchronous array merging.

The vocabulary file is a BPE with word ends (``</w>``): texts are normalised (NFC, lower case, white space
dropped), split into pre-tokens, and each pre-token's bytes are merged pair by pair in rank order. Here a
batch of pre-tokens is one ragged numpy array of symbols; in every round each sequence finds its lowest-rank
pair, all its occurrences (leftmost first where they overlap) are merged in all sequences at once, and
sequences without a mergeable pair leave the batch. The symbols that survive are the tokens.

White space never lies inside a pre-token, so the split is done once for each distinct white-space word of a
worker's recent batches; ``cache`` bounds these remembered counts, it does not change any result.

Defined results: a null or empty text has no tokens and no bytes. Special strings inside a text are one token
each, as the library treats them by default. Very long texts and words are counted whole. Rows with null ids and repeated rows are counted like others; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from threadtox.llm import textarrays as ta
from threadtox.llm.rows import arrow_map, typed

NONE = np.iinfo(np.int32).max
_ODD_SPACES = regex.compile("[\x1c-\x1f]")  # str.split() splits at these, the vocabulary's pattern doesn't


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


@dataclass
class Vocabulary:
    """What merging needs of a vocabulary file, as arrays sorted by pair."""

    inner: np.ndarray   # symbol of a byte inside a pre-token
    last: np.ndarray    # symbol of a pre-token's last byte
    pairs: np.ndarray   # left << 32 | right, ascending
    ranks: np.ndarray
    merged: np.ndarray
    pattern: str
    special: list[str]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, ids = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        left, right, to = [], [], []
        for a, b in model["merges"]:
            left.append(ids[a])
            right.append(ids[b])
            to.append(ids[a + b])
        pairs = np.array(left, dtype=np.int64) << 32 | np.array(right, dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        symbols = byte_symbols()
        return cls(np.array([ids[s] for s in symbols], dtype=np.int64),
                   np.array([ids[s + suffix] for s in symbols], dtype=np.int64), pairs[order],
                   np.arange(len(pairs), dtype=np.int32)[order], np.array(to, dtype=np.int64)[order],
                   pattern.replace(r"\s", r"\p{White_Space}"), [t["content"] for t in spec["added_tokens"]])


def merge_all(raw: np.ndarray, n: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """What survives of pre-tokens given end to end as bytes, of ``n`` bytes each (none of 0): their numbers, the symbols."""
    sym = v.inner[raw]
    ends = np.cumsum(n)
    sym[ends - 1] = v.last[raw[ends - 1]]
    seq = np.repeat(np.arange(len(n)), n)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        inside = seq[1:] == seq[:-1]
        pair = sym[:-1] << 32 | sym[1:]
        at = np.minimum(np.searchsorted(v.pairs, pair), len(v.pairs) - 1)
        known = inside & (v.pairs[at] == pair)
        rank = np.append(np.where(known, v.ranks[at], NONE), NONE)
        starts = np.flatnonzero(np.append(True, ~inside))
        best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(seq))))
        # occurrences that overlap (a pair of equal symbols): every second one of a run, from its left
        where = np.flatnonzero((rank == best) & (best != NONE))
        fresh = np.append(True, np.diff(where) > 1)
        run_start = where[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(where) else where
        where = where[(where - run_start) % 2 == 0]
        sym[where] = v.merged[at[where]]
        finished = best == NONE  # a sequence that merges nothing
        done.append((seq[finished], sym[finished]))
        keep = ~finished
        keep[where + 1] = False
        sym, seq = sym[keep], seq[keep]
    if not done:
        return np.zeros(len(n), dtype=np.int64), sym
    seq, sym = (np.concatenate(x) for x in zip(*done, strict=True))
    return np.bincount(seq, minlength=len(n)), sym[np.argsort(seq, kind="stable")]


class Counter:
    """Token counts of texts under one vocabulary, with remembered white-space words."""

    def __init__(self, v: Vocabulary, cache: int):
        self.v, self.limit, self.seen = v, cache, {}
        self.pre = regex.compile(v.pattern)
        self.special = regex.compile("|".join(map(regex.escape, v.special))) if v.special else None

    def _pieces(self, word: str) -> tuple[int, list[bytes]]:
        """Special strings in a word, and the pre-tokens of what is between them."""
        parts = self.special.split(word) if self.special else [word]
        pre: list[bytes] = []
        for part in parts:
            if part:
                text = part if unicodedata.is_normalized("NFC", part) else unicodedata.normalize("NFC", part)
                pre += [x.encode() for x in self.pre.findall(text.replace("Σ", "σ").lower())]
        return len(parts) - 1, pre

    def words(self, words: list[str]) -> list[int]:
        split = [self._pieces(w) for w in words]
        pre = {p: i for i, p in enumerate(dict.fromkeys(p for _, own in split for p in own))}
        raw = np.frombuffer(b"".join(pre), dtype=np.uint8)
        size = merge_all(raw, np.fromiter(map(len, pre), dtype=np.int64, count=len(pre)), self.v)[0].tolist()
        return [special + sum(size[pre[p]] for p in own) for special, own in split]

    def texts(self, texts: list[str]) -> list[int]:
        split = [[t] if _ODD_SPACES.search(t) else t.split() for t in texts]
        new = [w for w in set().union(*split) if w not in self.seen] if split else []
        if len(self.seen) + len(new) > self.limit:
            self.seen, new = {}, list(set().union(*split))
        for i in range(0, len(new), 1 << 16):
            part = new[i:i + (1 << 16)]
            self.seen.update(zip(part, self.words(part), strict=True))
        return [sum(map(self.seen.__getitem__, words)) for words in split]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, cache: int = 400_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs`` (doc_id, text).

    ``vocabulary`` is the file's place on the driver; the arrays (1 MB for 49k merges) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))
    held: list[Counter] = []

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Counter(shared.value, cache))
        for rows, texts in ta.sliced(batch, "text"):
            n = held[0].texts([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(rows.start, rows.stop - rows.start), pa.array([len(t) for t in texts], pa.int64()),
                pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(typed(docs, doc_id="long", text="string"), of,
                     "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
