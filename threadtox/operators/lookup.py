"""Values of tokens by word: sums of word vectors, ids, pieces.

A table that fits is broadcast and looked up in Arrow batches, where the tokens are: no token row is made and no text moves.
A table of vectors that is too large for the workers' memory is a file that they map.

A larger table of ids is joined with distinct words only. ``coded`` writes the rows once with their tokens as small integers:
rows are taken in chunks of a batch, and a chunk lists its distinct words once. The words of the chunks are joined with the
table (a shuffle on the word), and ``decoded`` brings a chunk's values to its rows. So what moves is an integer a token
and a word a chunk, not a row a token; a chunk is small, and no word or text makes one hot.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from threadtox.session import materialize, ship_package

CHUNK_TOKENS = 2_000_000   # tokens of a chunk, if one row has no more
SUM_TOKENS = 1 << 16       # token vectors added at a time


def _flat(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of the rows, and their tokens in one array (a null list has none)."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pc.list_flatten(tokens)


def _places(tokens: pa.Array, words: pa.Array) -> np.ndarray:
    """Place of each token in ``words``, -1 for others."""
    coded = tokens.dictionary_encode()
    known = pc.fill_null(pc.index_in(coded.dictionary, value_set=words), -1).to_numpy(zero_copy_only=False)
    codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    return np.append(known, -1)[codes]


def _list_array(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def summed_vectors(vectors: DataFrame, dim: int) -> Callable[[Column], Column]:
    """Column of token lists -> column with the sum of their vectors (array<double>, zeros for none), for a table (word,
    vector) that fits into every worker."""
    spark = vectors.sparkSession
    found = vectors.filter("word IS NOT NULL AND vector IS NOT NULL").select("word", "vector").toArrow()
    coded = found["word"].combine_chunks().cast(pa.string()).dictionary_encode()
    rows = found["vector"].combine_chunks()
    if pc.any(pc.not_equal(pc.list_value_length(rows), dim)).as_py():
        raise ValueError(f"a word vector does not have {dim} components")
    parts = pc.list_flatten(rows).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
    if len(coded.dictionary) < len(parts):  # a word listed twice counts with both vectors, as in a join
        table = np.zeros((len(coded.dictionary), dim), parts.dtype)
        np.add.at(table, coded.indices.to_numpy(zero_copy_only=False), parts)
    else:
        table = parts
    shared = spark.sparkContext.broadcast((coded.dictionary, table))
    ship_package(spark)

    @F.arrow_udf("array<double>")
    def total(tokens: pa.Array) -> pa.Array:
        words, vecs = shared.value
        offsets, flat = _flat(tokens)
        return _sums(offsets, _places(flat, words), vecs)

    return total


def _sums(offsets: np.ndarray, places: np.ndarray, vecs: np.ndarray) -> pa.Array:
    """Sums of the rows' vectors: the tokens' places in ``vecs``, -1 for none."""
    n, dim = len(offsets) - 1, vecs.shape[1]
    sums = np.zeros((n, dim))
    at = np.flatnonzero(places >= 0)
    row = np.searchsorted(offsets, at, side="right") - 1
    for i in range(0, len(at), SUM_TOKENS):
        r = row[i:i + SUM_TOKENS]
        first = np.flatnonzero(np.diff(r, prepend=-1))
        sums[r[first]] += np.add.reduceat(vecs[places[at[i:i + SUM_TOKENS]]], first, axis=0, dtype=np.float64)
    return _list_array(np.arange(n + 1) * dim, pa.array(sums.ravel()))


def mapped_vectors(vectors: DataFrame, dim: int) -> Callable[[Column], Column]:
    """As ``summed_vectors``, for a table that fits on the disk of every machine: one file, which Spark brings to each of them
    once and all its workers map. The driver writes it piece by piece. Words are found by their 64-bit hash."""
    spark = vectors.sparkSession
    single = vectors.schema["vector"].dataType.elementType.typeName() == "float"
    kind = np.dtype(np.float32 if single else np.float64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if pc.any(pc.not_equal(pc.list_value_length(b.column(1)), dim)).as_py():
                raise ValueError(f"a word vector does not have {dim} components")
            blobs = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
                     pc.list_flatten(b.column(1)).to_numpy(zero_copy_only=False).astype(kind).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], names=["hashes", "vectors"])

    ship_package(spark)
    table = vectors.filter("word IS NOT NULL AND vector IS NOT NULL").select(F.xxhash64("word").alias("h"), F.col("vector").cast(f"array<{'float' if single else 'double'}>"))
    path = Path(tempfile.mkdtemp(prefix="threadtox-vectors-")) / f"vectors-{uuid.uuid4().hex}"
    hashes = [np.zeros(0, np.int64)]
    with path.open("wb") as f:
        for r in table.mapInArrow(pack, "hashes binary, vectors binary").toLocalIterator():
            hashes.append(np.frombuffer(r.hashes, np.int64))
            f.write(r.vectors)
    found = np.concatenate(hashes)
    n = len(found)
    words, first, of = np.unique(found, return_index=True, return_inverse=True)
    if len(words) < n:  # a word listed twice counts with both vectors, as in a join
        rows = np.memmap(path, kind, "r+", shape=(n, dim))
        for i in np.flatnonzero(first[of] != np.arange(n)):
            rows[first[of[i]]] += rows[i]
        rows.flush()
    with path.open("ab") as f:
        f.write(b"\0" * (-f.tell() % 8))
        words.tofile(f)
        first.astype(np.int64).tofile(f)
    spark.sparkContext.addFile(str(path))
    name, known = path.name, len(words)

    @F.arrow_udf("array<double>")
    def total(tokens: pa.Array) -> pa.Array:
        from pyspark import SparkFiles

        offsets, flat = _flat(tokens)
        if not known:
            return _sums(offsets, np.full(len(flat), -1), np.zeros((0, dim)))
        file, ends = SparkFiles.get(name), n * dim * kind.itemsize
        ends += -ends % 8
        words, place = np.memmap(file, np.int64, "r", ends, (known,)), np.memmap(file, np.int64, "r", ends + 8 * known, (known,))
        own, at = np.unique(flat.to_numpy(zero_copy_only=False), return_inverse=True)
        near = np.minimum(np.searchsorted(words, own), known - 1)
        return _sums(offsets, np.where(words[near] == own, place[near], -1)[at], np.memmap(file, kind, "r", 0, (n, dim)))

    return lambda tokens: total(F.transform(tokens, lambda t: F.xxhash64(t)))


def shared_ids(vocab: DataFrame, word: str, index: str) -> Callable[[Column], Column]:
    """Column of token lists -> column of their ids (array<long>, null for other words), for a vocabulary that fits into
    every worker."""
    spark = vocab.sparkSession
    found = vocab.filter(F.col(word).isNotNull()).select(F.col(word).alias("w"), F.col(index).cast("long").alias("i")).toArrow()
    shared = spark.sparkContext.broadcast((found["w"].combine_chunks().cast(pa.string()), found["i"].combine_chunks()))
    ship_package(spark)

    @F.arrow_udf("array<long>")
    def ids(tokens: pa.Array) -> pa.Array:
        words, numbers = shared.value
        offsets, flat = _flat(tokens)
        places = _places(flat, words)
        return _list_array(offsets, numbers.take(pa.array(places, mask=places < 0)))

    return ids


# ---- tables that do not fit ------------------------------------------------------------------------------

_CODED = [StructField("__chunk", StringType()), StructField("__codes", ArrayType(IntegerType())), StructField("__words", ArrayType(StringType()))]


def coded(df: DataFrame, tokens: str, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``df`` without ``tokens``, written once with __chunk and __codes; further rows hold a chunk's distinct words (__words)."""
    kept = [f for f in df.schema.fields if f.name != tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, flat = _flat(b.column(len(kept)))
            start = 0
            while start < b.num_rows:
                end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + chunk_tokens, side="right")) - 1)
                part = flat.slice(offsets[start], offsets[end] - offsets[start]).dictionary_encode()
                n, chunk = end - start, uuid.uuid4().hex
                own = [b.column(i).slice(start, n) for i in range(len(kept))]
                codes = _list_array(offsets[start:end + 1] - offsets[start], part.indices.cast(pa.int32()))
                yield pa.RecordBatch.from_arrays([*own, pa.array([chunk] * n, pa.string()), codes, pa.nulls(n, pa.list_(pa.string()))], names=names)
                words = _list_array(np.array([0, len(part.dictionary)]), part.dictionary.cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, c.type) for c in own), pa.array([chunk]), pa.nulls(1, pa.list_(pa.int32())), words], names=names)
                start = end

    # everything may be null: a row of words has no columns of its own
    schema = StructType([*(StructField(f.name, f.dataType) for f in kept), *_CODED])
    names = schema.names
    ship_package(df.sparkSession)
    return materialize(df.select(*(f.name for f in kept), tokens).mapInArrow(run, schema), "coded-tokens")


def chunk_words(rows: DataFrame) -> DataFrame:
    """__chunk, __code, __w: the distinct words of the chunks."""
    return rows.filter("__words IS NOT NULL").select("__chunk", F.posexplode("__words").alias("__code", "__w"))


def decoded(rows: DataFrame, found: DataFrame, out: str) -> DataFrame:
    """The rows of ``coded`` with ``out``: in the order of the tokens the values of ``found`` (__chunk, __code, __value), null
    where it has none. Lists as values are joined end to end."""
    docs = rows.filter("__words IS NULL").drop("__words")
    kept = docs.columns[:-2]
    kind = found.schema["__value"].dataType
    lists = isinstance(kind, ArrayType)
    schema = StructType([*docs.schema.fields[:-2], StructField(out, kind if lists else ArrayType(LongType()))])

    def run(d: pa.Table, v: pa.Table) -> pa.Table:
        offsets, codes = _flat(d["__codes"].combine_chunks())
        place = v["__code"].combine_chunks().to_numpy(zero_copy_only=False)
        size = max(int(codes.to_numpy(zero_copy_only=False).max(initial=-1)), int(place.max(initial=-1))) + 1
        at = np.full(size, -1)
        at[place] = np.arange(len(place))
        at = at[codes.to_numpy(zero_copy_only=False)]
        values = v["__value"].combine_chunks().take(pa.array(at, mask=at < 0))
        if lists:
            inner, values = _flat(values)
            offsets = inner[offsets]
        return pa.table([*(d[c] for c in kept), _list_array(offsets, values)], names=[*kept, out])

    own = found.select(F.col("__chunk").alias("__of"), "__code", "__value").groupBy("__of")
    return docs.groupBy("__chunk").cogroup(own).applyInArrow(run, schema)
