"""Source divergence audit: how far the sources of each language are apart, and by which terms.

Texts are written in one folder a language and tokenised in Arrow batches. For each language a ``CountVectorizer`` with the given
``minDF`` and the largest integer as vocabulary size turns its documents into exact sparse count vectors. The vectors'
entries are summed by (source, term index) as a summarizer would, but sparsely and as integers, map-side first. From these
sums come the smoothed shares p of every group (lang, source) and q of every language, exactly.

Pairs are evaluated on the sparse sums. With z a group's share of a term it lacks, the distance of g and h is

    sum over g's terms of |p_g - z_h|  +  sum over h's terms of |z_g - p_h|  +  (V - n_g - n_h) |z_g - z_h|
    + sum over shared terms of (|p_g - p_h| - |p_g - z_h| - |z_g - p_h| + |z_g - z_h|)

The first two sums need only each group's distinct shares with their numbers of terms; the last visits, term by term in
Arrow batches, the groups that have it. All pairs of groups are part of the result, no pairs of documents are made.

Bounds: the driver and CountVectorizer's broadcast hold one language's vocabulary at a time (terms in ``min_docs``
documents or more); group and term tables stay distributed. A hot source or term is summed map-side; the joins within a
language are salted.

Defined results: null text, lang and source count as ''. Every row is a document, repeated rows and null ids too; very
long texts are read whole. A language with fewer than ``min_docs`` documents, or without a term in that many, keeps no
terms: its pairs have value 0 and it has no term rows. A source alone in its language has no pair rows. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadtox.llm import textarrays as ta
from threadtox.llm.rows import arrow_map, materialize
from threadtox.session import scratch_path, ship_package

#: Terms are runs of ASCII letters and non-ASCII characters; A-Z lower-cased.
LETTERS = ta._table(bytes(b for b in range(0x80) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)), lower=True)
LARGEST = 2**31 - 1
MERGE = 1 << 22  # vector entries that a task holds before it adds them up
SALTS = 64
MOST_LANGS = 100_000
PAIRS = 1 << 20  # pairs of one numpy step


def _plain(docs: DataFrame) -> DataFrame:
    """(lang, source, text) without nulls."""
    return docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _lists(chars: np.ndarray, size: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """Lists of ``n`` terms each, from the terms' bytes end to end and their sizes, each list with an empty string before."""
    first = np.concatenate([[0], np.cumsum(n)])
    size = np.insert(size, first[:-1], 0)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.tobytes()), pa.py_buffer(chars.tobytes()))
    return pa.ListArray.from_arrays(pa.array(first + np.arange(len(first)), pa.int32()), terms)


def _terms(rows: DataFrame, different: bool) -> DataFrame:
    """(source, terms): all terms of each text, or its different ones (by 64-bit keys of its words). Each list begins with an
    empty string: it stands in every document, so that no vocabulary is empty."""
    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, texts in ta.sliced(batch, "text"):
            w = ta.words_of(texts, LETTERS)
            a = np.frombuffer(w.data, dtype=np.uint8)
            chars, size, n = a[a != 0x20], w.ends - w.starts, w.counts
            if different:
                row = np.repeat(np.arange(len(texts)), n)
                once = np.zeros(len(size), dtype=bool)
                once[np.unique(ta.mix(w.hashes + row.astype(np.uint64) * ta._ROLL[0]), return_index=True)[1]] = True
                chars, size, n = chars[np.repeat(once, size)], size[once], np.bincount(row[once], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), _lists(chars, size, n)], names=["source", "terms"])

    return arrow_map(rows.select("source", "text"), of, "source string, terms array<string>")


def _share(count: Column, total: Column, kept: Column, prior: int, scale: int) -> Column:
    """1 + floor(scale * (count + prior) / (total + prior * kept)), exactly; null where no term is kept.

    Counts whose product with the scale would pass 64 bits go by decimals of 38 digits."""
    above, below = count + F.lit(prior), F.when(kept > 0, total + F.lit(prior) * kept)
    long = F.call_function("div", above * F.lit(scale).cast("long"), below)
    wide = F.call_function("div", above.cast("decimal(19,0)") * F.lit(scale).cast("decimal(18,0)"), below.cast("decimal(19,0)"))
    return F.when(above <= (2**63 - 1) // scale, long).otherwise(wide) + 1


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(found), dtype=np.int64)
    np.add.at(sums, at, np.concatenate(counts))
    return found, sums


def _sums(vectors: DataFrame, parts: int) -> DataFrame:
    """(source, term, count): the sums of sparse count vectors (source, indices, values) by source.

    Tasks add up their own vectors first and send each source's sums packed, in ``parts`` ranges of terms that are added
    up apart: a hot source is spread over them."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size, codes = 0, {}
        for b in batches:
            code = np.array([codes.setdefault(x, len(codes)) for x in b.column(0).to_pylist()], dtype=np.int64)
            lists = b.column(1)
            terms = lists.flatten().to_numpy().astype(np.int64)
            keys.append(np.repeat(code, np.diff(lists.offsets.to_numpy())) << 32 | terms)
            counts.append(b.column(2).flatten().to_numpy().astype(np.int64))
            size += len(terms)
            if size > MERGE:
                (key, n), size = _added(keys, counts), 0
                keys, counts = [key], [n]
        if keys:
            key, n = _added(keys, counts)
            names, code, term = list(codes), key >> 32, key & 0xFFFFFFFF
            order = np.lexsort((term, term % parts, code))
            code, term, n = code[order], term[order], n[order]
            edge = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (term[1:] % parts != term[:-1] % parts))) if len(n) else code
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(n)], strict=False):
                cell = n[i:j].tobytes() + term[i:j].astype(np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([names[code[i]]], pa.string()), pa.array([int(term[i] % parts)], pa.int32()), pa.array([cell], pa.binary())],
                                                 names=["source", "part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for cell in table.column("sums"):
            raw = cell.as_buffer()
            k = raw.size // 12
            counts.append(np.frombuffer(raw, dtype=np.int64, count=k))
            keys.append(np.frombuffer(raw, dtype=np.int32, count=k, offset=8 * k))
        term, n = _added(keys, counts)
        return pa.Table.from_arrays([pa.array([table.column("source")[0].as_py()] * len(term), pa.string()), pa.array(term, pa.int32()), pa.array(n)],
                                    names=["source", "term", "count"])

    ship_package(vectors.sparkSession)
    return vectors.mapInArrow(send, "source string, part int, sums binary").groupBy("source", "part").applyInArrow(add, "source string, term int, count long")


def group_sums(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, count) with the sums of the sparse vectors, and (lang, term, word): the kept terms."""
    spark = docs.sparkSession
    plain = _plain(docs)
    langs = [r.lang for r in plain.groupBy("lang").count().filter(F.col("count") >= min_docs).orderBy("lang").collect()]
    numbers = spark.createDataFrame(list(enumerate(langs)), "folder int, lang string")
    if len(langs) <= MOST_LANGS:
        numbers = F.broadcast(numbers)
    path = scratch_path(spark, "texts")
    plain.join(numbers, "lang").select("folder", "source", "text").write.partitionBy("folder").parquet(path)
    sums, words = [], []
    for folder, lang in enumerate(langs):
        own = spark.read.schema("source string, text string").parquet(f"{path}/folder={folder}")
        # which terms are kept follows from the documents that have them: repeats within one need not be read
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=LARGEST).fit(_terms(own, different=True))
        vectors = model.transform(_terms(own, different=False)).select("source", F.unwrap_udt("vector").alias("v")).select("source", "v.indices", "v.values")
        # a part of a source holds an entry a task and term at most
        parts = max(8, -(-own.rdd.getNumPartitions() * len(model.vocabulary) // MERGE))
        counts = _sums(vectors, parts)
        word = pd.DataFrame({"term": np.arange(len(model.vocabulary), dtype=np.int32), "word": model.vocabulary})
        kept = materialize(spark.createDataFrame(word, "term int, word string").filter("word <> ''"), "words")
        none = model.vocabulary.index("")
        words.append(kept.withColumn("lang", F.lit(lang)))
        sums.append(materialize(counts.filter(F.col("term") != none), "sums").withColumn("lang", F.lit(lang)))
    sums = sums or [spark.createDataFrame([], "source string, term int, count long, lang string")]
    words = words or [spark.createDataFrame([], "term int, word string, lang string")]
    return _all(sums), _all(words)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _shared_terms(lists: DataFrame) -> DataFrame:
    """(g, h, value) for g < h: the last sum of the pair formula, in parts, from the lists ``has`` of (g, p, z) by term."""
    lists = lists.filter(F.size("has") > 1).select("has.g", "has.p", "has.z")

    def step(g, p, z, first, second):
        a, b = g[first], g[second]
        value = np.abs(p[first] - p[second]) - np.abs(p[first] - z[second]) - np.abs(z[first] - p[second]) + np.abs(z[first] - z[second])
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((hi, lo))
        lo, hi, value = lo[order], hi[order], value[order]
        new = np.flatnonzero(np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(lo[new]), pa.array(hi[new]), pa.array(np.add.reduceat(value, new))], names=["g", "h", "value"])

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends = batch.column(0).offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        g, p, z = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(3))
        left = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(g)) - 1  # entries of the same term after each entry
        total = np.cumsum(left)
        at = 0
        while at < len(g):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
            n = left[at:to]
            first = np.repeat(np.arange(at, to), n)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
            if len(first):
                yield step(g, p, z, first, second)
            at = to

    return arrow_map(lists, of, "g long, h long, value long")


def audit(docs: DataFrame, min_docs: int = 30, top_terms: int = 50, prior: int = 5, scale: int = 1_000_000_000) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group (lang, source) of ``docs`` (lang, source, text).

    Part ``pair``: the distance to each other source of the language; part ``term``: the terms by which the group's share
    exceeds the language's, the first ``top_terms``. Both by descending value, then item.
    """
    sums, words = group_sums(docs, min_docs)
    kept = words.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = _plain(docs).select("lang", "source").distinct().join(kept, "lang", "left").fillna(0, ["kept"]) \
        .join(sums.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("n")), ["lang", "source"], "left").fillna(0, ["total", "n"])
    groups = materialize(groups.withColumn("z", F.coalesce(_share(F.lit(0), F.col("total"), F.col("kept"), prior, scale), F.lit(0))) \
        .withColumn("g", F.monotonically_increasing_id()), "groups")
    shares = sums.join(groups, ["lang", "source"]).select(
        "lang", "term", "count", "g", "z", _share(F.col("count"), F.col("total"), F.col("kept"), prior, scale).alias("p"))
    lists = materialize(shares.groupBy("lang", "term").agg(F.sum("count").alias("count"), F.collect_list(F.struct("g", "p", "z")).alias("has")), "shares")

    # pairs: every addend of a distance is a row (g, h, value)
    others = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("g").alias("h"),
                           F.col("z").alias("z_h"), F.col("n").alias("n_h"))
    salt = F.pmod(F.xxhash64("g", "p"), F.lit(SALTS)).cast("int")
    steps = lists.select("lang", F.explode("has").alias("e")).groupBy("lang", "e.g", "e.p").agg(F.count("*").alias("n")).withColumn("salt", salt)
    one_sided = steps.join(others, ["lang", "salt"]).filter("g <> h").groupBy("g", "h").agg(F.sum(F.col("n") * F.abs(F.col("p") - F.col("z_h"))).alias("value"))
    shared = _shared_terms(lists).groupBy("g", "h").agg(F.sum("value").alias("value"))
    lacking = groups.withColumn("salt", F.pmod(F.xxhash64("g"), F.lit(SALTS)).cast("int")).join(others, ["lang", "salt"]).filter("g <> h") \
        .select("g", "h", ((F.col("kept") - F.col("n") - F.col("n_h")) * F.abs(F.col("z") - F.col("z_h"))).alias("value"))
    addends = [lacking] + [x.select(a, b, "value").toDF("g", "h", "value") for x in (one_sided, shared) for a, b in (("g", "h"), ("h", "g"))]
    names = groups.select("lang", "source", "g")
    pairs = _all(addends).groupBy("g", "h").agg(F.sum("value").alias("value")) \
        .join(names, "g").join(groups.select(F.col("g").alias("h"), F.col("source").alias("item")), "h")

    # the best values of a group with their ties; only these are named
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kept").alias("kept"))
    general = lists.join(of_lang, "lang").select("lang", "term", "has", _share(F.col("count"), F.col("total"), F.col("kept"), prior, scale).alias("q"))
    above = general.select("lang", "term", F.explode("has").alias("e"), "q").select("lang", "term", "e.g", (F.col("e.p") - F.col("q")).alias("value")).filter("value > 0")
    best = above.withColumn("at", F.rank().over(Window.partitionBy("g").orderBy(F.col("value").desc()))).filter(F.col("at") <= top_terms)
    terms = best.join(words, ["lang", "term"]).join(names.drop("lang"), "g").select("lang", "source", F.col("word").alias("item"), "value")

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    cols = ["lang", "source", "part", "item", "value", "rank"]
    ranked = [part.withColumns({"part": F.lit(name), "rank": F.row_number().over(order)}) for part, name in ((pairs, "pair"), (terms, "term"))]
    return ranked[0].select(cols).unionByName(ranked[1].filter(F.col("rank") <= top_terms).select(cols))
