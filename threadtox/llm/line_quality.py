"""Quality rules: a linear-chain CRF marks each line as content or boilerplate; the content share decides.

The base rules count words, symbols, repeated lines and repeated three-word windows of a whole text; a text of
fewer than ``min_words`` words, or with more than ``max_repeat`` percent of its words in windows found twice or
more, fails. For the others Viterbi decoding labels the lines that have words, and the text is kept if at least
``min_share`` of its words stand in content lines.

The CRF is trained here on lines of documents that the table ``labels`` rates (quality 1: content, 0:
boilerplate): the ``sample`` rated documents with the smallest hash of their id, at most ``sample_lines`` lines
of each. Only training is bounded; every text is judged whole.

Defined results: a null text has no words and fails the base rules. Rows are judged one by one, whatever their
id, and repeated rows alike; an empty table gives an empty result. Labels with a null id or quality are not
used; without any label every line counts as content. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadtox.llm import crf
from threadtox.llm import textarrays as ta
from threadtox.llm.rows import arrow_map, typed

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_WS = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))
#: Features of a line; the last three are set against the line's length in characters.
FEATURES = ("one", "words", "long words", "distinct", "repeats", "sentence end", "capital share", "shouting", "symbol share",
            "marked words", "digit share", "exclamations")


def features(line: str, again: bool) -> list[float]:
    """Of one line with at least one word; ``again``: an equal line stands above it."""
    words = line.split()
    n, size = max(1, len(words)), len(line)
    letters = sum(map(str.isalpha, line)) or 1
    caps = sum(map(str.isupper, line)) / letters
    marks = sum(line.count(c) for c in "#*$%&|<>")
    bangs = line.count("!")
    distinct = len(set(words)) / n
    return [1.0, min(1.0, n / 40), float(size > 24 * n), distinct, float(again), float(line.rstrip()[-1:] in ".?:;\"')"),
            caps, float(caps > 0.6), min(1.0, 10 * marks / size), min(1.0, marks / n), min(1.0, 5 * (letters < size / 2)),
            min(1.0, bangs / n)]


def _lines(text: str) -> list[tuple[str, bool]]:
    """The lines that have words, each with whether it repeats an earlier one."""
    seen: set[str] = set()
    out = []
    for line in text.split("\n"):
        if line.strip(_WS):
            out.append((line, line in seen))
            seen.add(line)
    return out


def training_lines(docs: DataFrame, labels: DataFrame, sample: int, sample_lines: int) -> DataFrame:
    """(quality, features of the first lines end to end) of the sampled documents."""
    chosen = typed(labels, doc_id="long", quality="int").filter("doc_id IS NOT NULL AND quality IN (0, 1)") \
        .groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rated = typed(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, quality = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for rows, texts in ta.sliced(batch, "text"):
            x = [[f for line, again in _lines(t.decode("utf-8", "replace"))[:sample_lines] for f in features(line, again)] for t in texts]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[rows], pa.int64()), pa.array(quality[rows], pa.int32()), pa.array(x, pa.list_(pa.float32()))],
                names=["doc_id", "quality", "x"])

    return arrow_map(rated, of, "doc_id long, quality int, x array<float>")


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000, sample_lines: int = 200) -> crf.Chain:
    rows = training_lines(docs, labels, sample, sample_lines).filter("size(x) > 0").collect()  # bounded by the two parameters
    rows = sorted(((r.doc_id, r.quality, r.x) for r in rows), key=lambda r: (r[0], r[2]))
    width = len(FEATURES)
    lengths = np.array([len(x) // width for _, _, x in rows], dtype=np.int64)
    x = np.array([f for _, _, own in rows for f in own], dtype=np.float64).reshape(-1, width)
    return crf.fit(x, np.repeat(np.array([q for _, q, _ in rows], dtype=np.int64), lengths), lengths)


def _counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The base counts of whole texts."""
    w = ta.words_of(texts, ta.WORDS_AS_IS)
    n = w.counts
    raw = np.frombuffer(w.data, dtype=np.uint8)
    chars = np.concatenate([[0], np.cumsum((raw != 0x20) & ((raw & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[raw])])
    edges = w.offsets
    repeats = np.zeros(len(texts), dtype=np.int64)
    grams, first = ta.shingles(w, 3)
    for i in np.flatnonzero(n >= 3):
        own = grams[first[i]:first[i + 1]]
        _, inverse, count = np.unique(own, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[inverse] > 1)
        if len(twice):
            cover = np.zeros(n[i], dtype=bool)
            for k in range(3):
                cover[twice + k] = True
            repeats[i] = cover.sum()
    return {"n_words": n, "word_chars": chars[edges[1:]] - chars[edges[:-1]],
            "n_symbols": symbols[edges[1:]] - symbols[edges[:-1]], "n_repeat_words": repeats}


def _verdicts(texts: list[bytes], chain: crf.Chain, min_words: int, max_repeat: int, min_share: float):
    """Of a slice of texts: base counts, repeated lines, base_failed, content_share, kept."""
    c = _counts(texts)
    lines = [_lines(t.decode("utf-8", "replace")) for t in texts]
    failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat * c["n_words"])
    x = np.array([features(*line) for own, bad in zip(lines, failed, strict=True) if not bad for line in own],
                 dtype=np.float64).reshape(-1, len(FEATURES))
    lengths = np.array([0 if bad else len(own) for own, bad in zip(lines, failed, strict=True)], dtype=np.int64)
    label = crf.viterbi(chain, x, lengths)
    at = np.concatenate([[0], np.cumsum(lengths)])
    share = []
    for i, own in enumerate(lines):
        size = np.array([len(line.encode().split()) for line, _ in own]) if lengths[i] else np.zeros(0)
        share.append(float((size * label[at[i]:at[i + 1]]).sum() / size.sum()) if lengths[i] else None)
    kept = [not bad and s >= min_share for s, bad in zip(share, failed, strict=True)]
    return c, [sum(again for _, again in own) for own in lines], failed, share, kept


def judge(docs: DataFrame, chain: crf.Chain, min_words: int = 50, max_repeat: int = 50, min_share: float = 0.5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the counts, base_failed, content_share, kept."""
    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, texts in ta.sliced(batch, "text"):
            c, repeats, failed, share, kept = _verdicts(texts, chain, min_words, max_repeat, min_share)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(rows.start, rows.stop - rows.start), pa.array(c["n_words"]), pa.array(c["word_chars"]),
                pa.array(c["n_symbols"]), pa.array(repeats, pa.int64()),
                pa.array(c["n_repeat_words"]), pa.array(failed), pa.array(share, pa.float64()), pa.array(kept, pa.bool_())],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"])

    return arrow_map(typed(docs, doc_id="long", text="string"), of,
                     "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                     "base_failed boolean, content_share double, kept boolean")


def quality(docs: DataFrame, labels: DataFrame, sample: int = 2000, **rules) -> DataFrame:
    """``judge`` with a CRF trained on the rated documents."""
    return judge(docs, train(docs, labels, sample), **rules)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 2000, min_words: int = 50, max_repeat: int = 50, min_share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns."""
    chain = train(docs, labels, sample)

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, texts in ta.sliced(batch, "text"):
            kept = _verdicts(texts, chain, min_words, max_repeat, min_share)[-1]
            yield batch.slice(rows.start, rows.stop - rows.start).filter(pa.array(kept, pa.bool_()))

    return arrow_map(docs, of, docs.schema)
