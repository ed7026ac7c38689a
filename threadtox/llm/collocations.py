"""Phrase collocations from depth-truncated suffix subtrees, after vertical partitioning (as ERA builds suffix trees).

Texts are cut into pieces and words; every word occurrence begins a suffix of at most three words of its piece. Per
language:

1. Words are counted (map-side first). Only words of ``min_count`` occurrences can be part of a candidate.
2. Vertical partitioning. One-word prefixes are packed into groups of about ``budget`` occurrences. A word beyond the
   budget is extended: its two-word prefixes are counted and dealt to groups of their own, and a two-word prefix beyond
   the budget is extended to three words. So no group grows with a hot word, phrase, source or set of copies.
3. The texts are scanned once more; tasks sort and merge their suffixes and send each group's as one packed row. A suffix
   ends before a word that is too rare.
4. Each group builds its subtrees independently: sorted suffixes are the leaves in order, and the totals of the leaves
   below a node are the phrase's count. Nodes of ``min_count`` or more are returned.
5. Candidates are joined with the counts of their parts; scores are exact in decimals of 38 digits.

The words that tasks look up, with their groups, go out as a broadcast of at most ``max_words`` words (12 bytes each).
With more of them the texts are scanned once for each slice of the words. Words are known by 64-bit keys of language and
word; a check over all words makes sure that no two share a key (it raises if they do). Groups take about 28 bytes an
occurrence in one task, 2 to 3 budgets at most.

Defined results: null text counts as '', null lang as ``und``. Texts without words give nothing; a very long text is cut
at slices of texts, never inside one. Repeated rows and null ids count as documents of their own. A language whose phrases
are all rarer than ``min_count`` has no rows, as has an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadtox.llm import textarrays as ta
from threadtox.llm.rows import arrow_map, materialize
from threadtox.session import ship_package

BREAKS = b".,;:!?\n\x0b\x0c\r"
TABLE = ta._table(b" \t" + BREAKS, lower=True)
_IS_BREAK = np.isin(np.arange(256), list(BREAKS))
SLICE = 8 << 20         # bytes of text whose words are counted at a time
SUFFIX_SLICE = 2 << 20  # and whose suffixes are made


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def _occurrences(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[ta.Words, np.ndarray, np.ndarray, list[str]]]:
    """The words of some rows (lang, text), with the key and the piece of every occurrence, and the rows' languages."""
    for rows, texts in ta.sliced(batch, "text", limit):
        langs = batch.column(0).slice(rows.start, rows.stop - rows.start).to_pylist()
        salt = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(langs)}
        w = ta.words_of(texts, TABLE)
        breaks = np.flatnonzero(_IS_BREAK[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)])
        keys = ta.mix(w.hashes ^ np.repeat(np.array([salt[x] for x in langs], dtype=np.uint64), w.counts))
        keys[keys == 0] = 1  # 0 is the end of a suffix
        yield w, keys, np.searchsorted(breaks, w.starts), langs


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, key, f): every word of each language with its occurrences."""
    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for w, keys, _, langs in _occurrences(batch, SLICE):
            _, at, n = np.unique(keys, return_index=True, return_counts=True)
            row = np.searchsorted(w.first, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[i] for i in row.tolist()], pa.string()), pa.array([w.word(i) for i in at.tolist()], pa.binary()).cast(pa.string()),
                 pa.array(keys[at].view(np.int64)), pa.array(n)], names=["lang", "word", "key", "f"])

    return arrow_map(_plain(docs), of, "lang string, word string, key long, f long") \
        .groupBy("lang", "word").agg(F.first("key").alias("key"), F.sum("f").alias("f"))


@dataclass
class Prefixes:
    """Where suffixes go: words by key with their first group and number of groups; extended two-word prefixes likewise."""

    keys: np.ndarray
    group: np.ndarray
    parts: np.ndarray
    whole: bool               # all frequent words are here, not a slice of them
    deep: np.ndarray
    deep_group: np.ndarray
    deep_parts: np.ndarray

    @classmethod
    def pack(cls, keys: np.ndarray, counts: np.ndarray, budget: int, whole: bool) -> Prefixes:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        hot = counts > budget
        parts = np.where(hot, -(-2 * counts // budget), 1).astype(np.int32)
        group = (np.cumsum(np.where(hot, 0, counts)) // budget).astype(np.int32)
        base = int(group.max(initial=0)) + 1
        group[hot] = base + np.cumsum(parts[hot]) - parts[hot]
        none = np.zeros(0, dtype=np.uint64)
        return cls(keys, group, parts, whole, none, none.astype(np.int32), none.astype(np.int32))

    @property
    def groups(self) -> int:
        return int(np.append(self.group + self.parts, self.deep_group + self.deep_parts).max(initial=0))

    def extend(self, pairs: np.ndarray, counts: np.ndarray, budget: int) -> Prefixes:
        order = np.argsort(pairs)
        parts = -(-2 * counts[order] // budget).astype(np.int32)
        return Prefixes(self.keys, self.group, self.parts, self.whole, pairs[order], (self.groups + np.cumsum(parts) - parts).astype(np.int32), parts)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)

    def suffixes(self, keys: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place of the first word among the prefixes, three keys) of each suffix of two words or more; 0 for no third."""
        at, known = self.find(keys)
        joined = np.append(piece[1:] == piece[:-1], False) if len(piece) else np.zeros(0, dtype=bool)
        if self.whole and len(keys):
            joined[:-1] &= known[1:]  # a suffix ends before a rare word
        i = np.flatnonzero(known & joined)
        third = np.where(joined[i + 1], keys[np.minimum(i + 2, len(keys) - 1)], np.uint64(0))
        return at[i], keys[i], keys[i + 1], third

    def route(self, at: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
        group = self.group[at].astype(np.int64)
        hot = np.flatnonzero(self.parts[at] > 1)
        if len(hot):
            group[hot] += (ta.mix(two[hot]) % self.parts[at[hot]].astype(np.uint64)).astype(np.int64)
            if len(self.deep):
                pair = pair_key(one[hot], two[hot])
                d = np.minimum(np.searchsorted(self.deep, pair), len(self.deep) - 1)
                of = self.deep[d] == pair
                group[hot[of]] = self.deep_group[d[of]] + (ta.mix(three[hot[of]]) % self.deep_parts[d[of]].astype(np.uint64)).astype(np.int64)
        return group


def pair_key(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return ta.mix(one * ta._ROLL[0] + two * ta._ROLL[1])


def merged(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct rows of the key columns in ascending order, with the sums of n."""
    if not len(n):
        return keys, n
    order = np.lexsort(keys[::-1])
    keys, n = tuple(k[order] for k in keys), n[order]
    new = np.zeros(len(n), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return tuple(k[first] for k in keys), np.add.reduceat(n, first)


def _hot_pairs(texts: DataFrame, shared, budget: int) -> list:
    """(pair, one, two, n) of two-word prefixes beyond the budget; there are at most occurrences / budget of them."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, held, size = shared.value, [], 0

        def send() -> pa.RecordBatch:
            one, two = (np.concatenate(x) for x in zip(*held, strict=True))
            (one, two), n = merged((one, two), np.ones(len(one), dtype=np.int64))
            return pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(n)], names=["one", "two", "n"])

        for b in batches:
            for _, keys, piece, _ in _occurrences(b, SUFFIX_SLICE):
                at, one, two, _ = p.suffixes(keys, piece)
                hot = p.parts[at] > 1
                held.append((one[hot], two[hot]))
                size += len(held[-1][0])
                if size > 1 << 20:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    ship_package(texts.sparkSession)
    return texts.mapInArrow(of, "one long, two long, n long").groupBy("one", "two").agg(F.sum("n").alias("n")).filter(F.col("n") > budget).collect()


def _packed(texts: DataFrame, shared, flush: int) -> DataFrame:
    """(group, suffixes): each task's merged suffixes of a group, packed as three key columns and a count column."""
    def send(p: Prefixes, held: list) -> Iterator[pa.RecordBatch]:
        at, one, two, three = (np.concatenate(x) for x in zip(*held, strict=True))
        group = p.route(at, one, two, three)
        (group, one, two, three), n = merged((group, one, two, three), np.ones(len(group), dtype=np.int64))
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else group
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(group)], strict=False):
            cell = b"".join((one[a:b].tobytes(), two[a:b].tobytes(), three[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([group[a]], pa.int32()), pa.array([cell], pa.binary())], names=["group", "suffixes"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, held, size = shared.value, [], 0
        for b in batches:
            for _, keys, piece, _ in _occurrences(b, SUFFIX_SLICE):
                held.append(p.suffixes(keys, piece))
                size += len(held[-1][0])
                if size >= flush:
                    yield from send(p, held)
                    held, size = [], 0
        if held:
            yield from send(p, held)

    ship_package(texts.sparkSession)
    return texts.mapInArrow(of, "group int, suffixes binary")


def subtrees(one: np.ndarray, two: np.ndarray, three: np.ndarray, n: np.ndarray, min_count: int) -> tuple[np.ndarray, ...]:
    """Nodes (three keys, count) of two and three words (third key 0 for two) with ``min_count`` occurrences or more."""
    (one, two, three), n = merged((one, two, three), n)  # the leaves, in order
    if not len(n):
        return one, two, three, n
    branch = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    total = np.add.reduceat(n, branch)
    inner, leaf = total >= min_count, (three != 0) & (n >= min_count)
    return (np.append(one[branch][inner], one[leaf]), np.append(two[branch][inner], two[leaf]),
            np.append(np.zeros(int(inner.sum()), dtype=np.uint64), three[leaf]), np.append(total[inner], n[leaf]))


def _grown(packed: DataFrame, groups: int, shared, min_count: int) -> DataFrame:
    """(one, two, three, a): the nodes of all groups' subtrees; three is 0 for phrases of two words."""
    def of(table: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for cell in table.column("suffixes"):
            raw = cell.as_buffer()
            k = raw.size // 28
            for c in range(3):
                columns[c].append(np.frombuffer(raw, dtype=np.uint64, count=k, offset=8 * k * c))
            columns[3].append(np.frombuffer(raw, dtype=np.uint32, count=k, offset=24 * k).astype(np.int64))
        one, two, three, a = subtrees(*(np.concatenate(x) for x in columns), min_count)
        own = (three != 0) | ~np.isin(pair_key(one, two), shared.value.deep)  # an extended pair's total is over several groups
        return pa.Table.from_arrays([pa.array(x[own].view(np.int64)) for x in (one, two, three, a)], names=["one", "two", "three", "a"])

    return packed.repartition(max(1, groups), "group").groupBy("group").applyInArrow(of, "one long, two long, three long, a long")


def phrases(docs: DataFrame, words: DataFrame, min_count: int, budget: int, max_words: int, flush: int) -> DataFrame:
    """(one, two, three, a): keys and counts of all phrases of two (three = 0) and three words with ``min_count`` occurrences."""
    spark, texts = docs.sparkSession, _plain(docs)
    slices = max(1, -(-words.count() // max_words))
    out = []
    for i in range(slices):
        own = words.filter(F.pmod("key", F.lit(slices)) == i).select("key", "f").toArrow()  # about max_words rows
        p = Prefixes.pack(own.column("key").to_numpy().view(np.uint64), own.column("f").to_numpy(), budget, slices == 1)
        if (p.parts > 1).any():
            hot = _hot_pairs(texts, spark.sparkContext.broadcast(p), budget)
            if hot:
                one, two, n = (np.array([r[c] for r in hot], dtype=np.int64) for c in range(3))
                p = p.extend(pair_key(one.view(np.uint64), two.view(np.uint64)), n, budget)
                out.append(spark.createDataFrame([(r.one, r.two, 0, r.n) for r in hot], "one long, two long, three long, a long"))
        shared = spark.sparkContext.broadcast(p)
        out.append(materialize(_grown(_packed(texts, shared, flush), p.groups, shared, min_count), "nodes"))
        shared.unpersist()
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every


def collocations(docs: DataFrame, min_count: int = 10, percent: int = 50, top: int = 2000, scale: int = 1_000_000,
                 budget: int = 1 << 20, max_words: int = 4_000_000, flush: int = 1 << 19) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each language of ``docs`` (lang, text).

    A phrase of a occurrences whose cut gives parts of l and r scores floor(scale * a * a / (l * r)), at its worst cut. It is
    dropped if a longer candidate that contains it has at least ``percent`` percent of its occurrences.
    """
    words = materialize(word_counts(docs), "words")
    if words.groupBy("key").count().filter("count > 1").limit(1).count():
        raise ValueError("two words share a 64-bit key")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = materialize(words.filter(F.col("f") >= min_count), "frequent")
    nodes = phrases(docs, known, min_count, budget, max_words, flush)
    pairs, triples = nodes.filter("three = 0").drop("three"), nodes.filter("three <> 0")

    def word(key: str) -> DataFrame:
        return known.select(F.col("key").alias(key), "lang" if key == "one" else F.col("lang").alias(f"lang_{key}"),
                            F.col("word").alias(f"word_{key}"), F.col("f").alias(f"f_{key}"))

    def score(left: str, right: str):
        a, parts = F.col("a").cast("decimal(14,0)"), F.col(left).cast("decimal(19,0)") * F.col(right).cast("decimal(19,0)")
        return F.call_function("div", a * a * F.lit(scale).cast("decimal(7,0)"), parts)

    longer = triples.select("one", "two", "a").unionByName(triples.select(F.col("two").alias("one"), F.col("three").alias("two"), "a")) \
        .groupBy("one", "two").agg(F.max("a").alias("longer"))
    two = pairs.join(longer, ["one", "two"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent)) \
        .join(word("one"), "one").join(word("two"), "two") \
        .select("lang", F.concat_ws(" ", "word_one", "word_two").alias("phrase"), "a", F.col("f_one").alias("l"), F.col("f_two").alias("r"),
                score("f_one", "f_two").alias("score"))
    three = triples.join(pairs.select("one", "two", F.col("a").alias("start")), ["one", "two"]) \
        .join(pairs.select(F.col("one").alias("two"), F.col("two").alias("three"), F.col("a").alias("rest")), ["two", "three"]) \
        .join(word("one"), "one").join(word("two"), "two").join(word("three"), "three") \
        .withColumns({"first": score("f_one", "rest"), "second": score("start", "f_three")})
    early = F.col("first") <= F.col("second")
    three = three.select("lang", F.concat_ws(" ", "word_one", "word_two", "word_three").alias("phrase"), "a", F.when(early, F.col("f_one")).otherwise(F.col("start")).alias("l"),
                         F.when(early, F.col("rest")).otherwise(F.col("f_three")).alias("r"), F.least("first", "second").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return two.unionByName(three).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).join(sizes, "lang") \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
