"""Text operators: word counts, the ranked vocabulary, token -> id sequences, padding, word vectors and
pooled text vectors.

Tokens find their ids and vectors by word, in place where the table fits (see :mod:`lookup`). The vocabulary rank is
global but computed in buckets (see :mod:`ranking`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadtox.functions.text import word_tokens
from threadtox.operators import lookup as L
from threadtox.operators.ranking import exact_row_number

POOL_EPS = 1e-10


def tokenize(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    """Add the word-token array of ``text`` (null text gives an empty list)."""
    return df.withColumn(out, F.coalesce(word_tokens(F.col(text)), F.array().cast("array<string>")))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """word, freq over all texts (partial counts per task before the shuffle)."""
    ex = df.select(F.explode(word_tokens(F.col(text))).alias("word"))
    return ex.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


ID_BUCKETS = 4096  # most first-position buckets per frequency class in the vocabulary rank


def word_index(df: DataFrame, text: str = "text", key: str = "id", id_bucket_bits: int | None = None) -> DataFrame:
    """Ranked vocabulary: word, word_id (1..V by frequency desc, ties by first appearance), freq.

    "First appearance" is the smallest (row key, token position), i.e. rows are read in key order. The
    rank is exact and global, computed per bucket (count, key >> bits) plus bucket offsets, so neither the
    many count-1 words nor one huge count class is ranked inside a single task. Without ``id_bucket_bits``
    the shift follows the largest key (one aggregate over the key column): at least 12 bits, and enough
    that a frequency class has at most ``ID_BUCKETS`` buckets, which bounds the offset table.
    """
    if id_bucket_bits is None:
        max_key = df.agg(F.max(F.col(key))).first()[0] or 0
        id_bucket_bits = max(12, math.ceil(math.log2((max_key + 1) / ID_BUCKETS))) if max_key > 0 else 12
    ex = df.select(F.col(key).alias("__k"), F.posexplode(word_tokens(F.col(text))).alias("__pos", "word"))
    stats = ex.groupBy("word").agg(F.count(F.lit(1)).alias("freq"),
                                   F.min(F.struct("__k", "__pos")).alias("__first"))
    stats = stats.select("word", "freq", F.col("__first.__k").alias("__fk"), F.col("__first.__pos").alias("__fp"))
    ranked = exact_row_number(stats, [], [F.col("freq").desc(), F.col("__fk"), F.col("__fp")],
                              [-F.col("freq"), F.shiftright(F.col("__fk"), id_bucket_bits)],
                              name="word_id")
    return ranked.select("word", F.col("word_id").cast("long").alias("word_id"), F.col("freq").cast("long").alias("freq"))


def vocab_size(index: DataFrame) -> DataFrame:
    """vocab_size = largest id + 1 (id 0 is padding); embedding_rows = vocab_size + 2."""
    return index.agg((F.coalesce(F.max("word_id"), F.lit(0)) + F.lit(1)).cast("long").alias("vocab_size")) \
        .withColumn("embedding_rows", F.col("vocab_size") + F.lit(2))


BROADCAST_MB = 100   # largest side table (as it lies in memory) that is broadcast


def fits_broadcast(n_rows: int, row_bytes: int, max_mb: float) -> bool:
    """Whether ``n_rows`` rows of about ``row_bytes`` bytes each stay within ``max_mb`` megabytes."""
    return n_rows * row_bytes <= max_mb * 1e6


def by_content(df: DataFrame, tokens: str) -> DataFrame:
    """``df`` with 96 hash bits of the token list: a result that depends on the tokens alone joins back by key and
    content, so rows that share an id, or have none, keep their own results."""
    return df.withColumns({"__h": F.xxhash64(tokens), "__g": F.hash(tokens)})


def join_content(d: DataFrame, r: DataFrame, key: str) -> DataFrame:
    r = r.withColumnsRenamed({"__h": "__rh", "__g": "__rg"})
    cond = d[key].eqNullSafe(r["__k"]) & (d["__h"] == r["__rh"]) & (d["__g"] == r["__rg"])
    return d.join(r, cond, "left").drop("__k", "__rh", "__rg", "__h", "__g")


def tokens_to_ids(df: DataFrame, vocab: DataFrame, tokens: str, out: str, key: str = "id",
                  word: str = "word", index: str = "word_id", unknown_id: int | Column | None = None,
                  max_broadcast_mb: float = BROADCAST_MB, keep_tokens: bool = True) -> DataFrame:
    """Map each token to its vocabulary id, keeping order. Tokens outside the vocabulary are dropped
    (``unknown_id=None``) or mapped to ``unknown_id``. Rows without tokens get an empty list; repeated and null
    ids are fine.

    A vocabulary within ``max_broadcast_mb`` (counted first; about 100 bytes a word) is looked up where the rows are.
    Beyond it the rows are written once with their tokens as integers, and distinct words are joined with it; with
    ``keep_tokens=False`` the tokens themselves neither move nor come back."""
    if isinstance(unknown_id, Column):  # may be a subquery, which a higher-order function cannot take
        unknown_id, keep = df.sparkSession.range(1).select(unknown_id).first()[0], True
    else:
        keep = unknown_id is not None
    r = _token_ids(df, vocab, tokens, out, word, index, max_broadcast_mb, keep_tokens)
    if not keep:
        return r.withColumn(out, F.filter(out, lambda x: x.isNotNull()))
    return r if unknown_id is None else r.withColumn(out, F.transform(out, lambda x: F.coalesce(x, F.lit(unknown_id).cast("long"))))


def _token_ids(df: DataFrame, vocab: DataFrame, tokens: str, out: str, word: str, index: str, max_broadcast_mb: float, keep_tokens: bool) -> DataFrame:
    """``df`` with an id for each token, null for words that the vocabulary lacks."""
    if fits_broadcast(vocab.count(), 100, max_broadcast_mb):
        r = df.withColumn(out, F.coalesce(L.shared_ids(vocab, word, index)(F.col(tokens)), F.array().cast("array<long>")))
        return r if keep_tokens else r.drop(tokens)
    d = L.coded(df.withColumn("__tokens_of", F.col(tokens)), "__tokens_of") if keep_tokens else L.coded(df, tokens)
    v = vocab.select(F.col(word).alias("__w"), F.col(index).cast("long").alias("__value"))
    return L.decoded(d, L.chunk_words(d).join(v, "__w").select("__chunk", "__code", "__value"), out)


def texts_to_sequences(df: DataFrame, vocab: DataFrame, text: str = "text", out: str = "seq",
                       key: str = "id") -> DataFrame:
    """Word ids of ``text`` in order; words the vocabulary does not know are dropped."""
    t = df.withColumn("__tok", F.coalesce(word_tokens(F.col(text)), F.array().cast("array<string>")))
    return tokens_to_ids(t, vocab, "__tok", out, key, keep_tokens=False)


def sequences(df: DataFrame, vocab: DataFrame, texts: dict[str, str], keep: Sequence[str] = ("id",),
              max_broadcast_mb: float = BROADCAST_MB) -> DataFrame:
    """The columns ``keep``, and for each text column of ``texts`` its word ids in order under the name given there; words
    the vocabulary does not know are dropped. All texts of a row are looked up in one pass, as one list of tokens, and
    no text moves."""
    none = F.array().cast("array<string>")
    t = df.select(*keep, *(F.coalesce(word_tokens(F.col(c)), none).alias(f"__t{i}") for i, c in enumerate(texts)))
    sizes = [F.size(f"__t{i}").alias(f"__n{i}") for i in range(len(texts))]
    t = t.select(*keep, *sizes, F.concat(*(f"__t{i}" for i in range(len(texts)))).alias("__tok"))
    r = _token_ids(t, vocab, "__tok", "__ids", "word", "word_id", max_broadcast_mb, keep_tokens=False)
    outs, start = [], F.lit(1)
    for i, out in enumerate(texts.values()):
        outs.append(F.filter(F.slice("__ids", start, F.col(f"__n{i}")), lambda x: x.isNotNull()).alias(out))
        start = start + F.col(f"__n{i}")
    return r.select(*keep, *outs)


def parse_word_vectors(lines: DataFrame, line: str = "value", order: Column | None = None) -> DataFrame:
    """word, vector (array<float>) from lines 'word c1 c2 ...' split on whitespace; a word listed twice
    keeps its last line (``order`` gives the line order; by default the read order)."""
    parts = F.split(F.trim(F.col(line)), r"\s+")
    o = order if order is not None else F.monotonically_increasing_id()
    p = lines.select(o.alias("__line"), parts.alias("__p")).where(F.size("__p") > 1)
    p = p.select("__line", F.element_at("__p", 1).alias("word"),
                 F.transform(F.slice("__p", 2, F.size("__p") - 1), lambda x: x.cast("float")).alias("vector"))
    last = p.groupBy("word").agg(F.max_by(F.col("vector"), F.col("__line")).alias("vector"))
    return last


def read_word_vectors(spark, path: str) -> DataFrame:
    """Text files of word vectors -> word, vector; of a word listed twice the last line counts, in the order of file
    name, place in the file, line (a file that is read in several pieces keeps its order)."""
    lines = spark.read.text(path).select("value", F.struct(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("__order"))
    return parse_word_vectors(lines, order=F.col("__order"))


def embedding_lookup(vocab: DataFrame, vectors: DataFrame, dim: int, word: str = "word") -> DataFrame:
    """Vocabulary rows with their vector; unknown words get a zero vector of length ``dim``."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    j = vocab.join(vectors.select(F.col(word), F.col("vector")), word, "left")
    return j.withColumn("vector", F.coalesce(F.col("vector"), zero))


VECTORS_MB = 64    # largest table of word vectors that every Python worker holds
MAPPED_MB = 8192   # largest table of word vectors that every machine holds as a file


def _vector_bytes(vectors: DataFrame, component: int = 8) -> int:
    """About the memory of one row of a vector table: ``component`` bytes a component, and the word."""
    first = vectors.select(F.size("vector").alias("n")).first()
    return 100 + component * max(0, first.n if first and first.n is not None else 0)


_POOLS: list[tuple[str, DataFrame, int, tuple[float, float], Callable[[Column], Column]]] = []


def mean_pool(vectors: DataFrame, dim: int, max_broadcast_mb: float = VECTORS_MB, max_mapped_mb: float = MAPPED_MB) -> Callable[[Column], Column] | None:
    """The masked mean as a function of a token column, for a vector table within ``max_broadcast_mb`` in the workers' memory, or
    within ``max_mapped_mb`` as a file that they map; none beyond it. The last few tables stay shared: every stage and run
    that pools with one takes the same."""
    app, bounds = vectors.sparkSession.sparkContext.applicationId, (max_broadcast_mb, max_mapped_mb)
    total = next((t for a, v, n, b, t in _POOLS if a == app and n == dim and b == bounds and v.sameSemantics(vectors)), None)
    if total is None:
        single = vectors.schema["vector"].dataType.elementType.typeName() == "float"
        rows, each = vectors.count(), _vector_bytes(vectors, 4 if single else 8)
        if not fits_broadcast(rows, each, max(bounds)):
            return None
        total = (L.summed_vectors if fits_broadcast(rows, each, max_broadcast_mb) else L.mapped_vectors)(vectors, dim)
        _POOLS[:] = [*_POOLS[-3:], (app, vectors, dim, bounds, total)]

    def pool(tokens: Column) -> Column:
        return F.transform(total(tokens), lambda x: x / (F.size(tokens).cast("double") + F.lit(POOL_EPS)))
    return pool


def masked_mean_pool(df: DataFrame, vectors: DataFrame, dim: int | Column, tokens: str = "tokens", key: str = "id",
                     out: str = "pooled", max_broadcast_mb: float = VECTORS_MB, max_mapped_mb: float = MAPPED_MB) -> DataFrame:
    """Sum of the token vectors over the real tokens / (number of real tokens + 1e-10); tokens without a
    vector contribute zeros but still count.

    Within ``max_broadcast_mb`` (words counted, times the vector's bytes) in the workers' memory, or within ``max_mapped_mb`` in a
    file on every machine, the tokens are summed where the rows are: nothing is shuffled. Beyond it, tokens are first reduced to (document, word) counts, the join ships one vector per distinct
    word of a document, weighted by its count, and the sums (``Summarizer``) join back by id and token content, so
    repeated and null ids keep their own results.
    """
    if isinstance(dim, Column):
        dim = df.sparkSession.range(1).select(dim).first()[0]
    if pool := mean_pool(vectors, dim, max_broadcast_mb, max_mapped_mb):
        return df.select(key, pool(F.col(tokens)).alias(out))
    d = by_content(df.select(key, tokens), tokens)
    at = ["__k", "__h", "__g"]
    # each row has one first token: their number says how many equal rows of an id the sum holds
    ex = d.select(F.col(key).alias("__k"), "__h", "__g", F.posexplode(F.col(tokens)).alias("__pos", "word")) \
        .select(*at, "word", F.lit(1.0).alias("__n"), F.when(F.col("__pos") == 0, 1).otherwise(0).alias("__rows"))
    vec = vectors.select("word", array_to_vector(F.col("vector")).alias("__v"))
    ex = ex.groupBy(*at, "word").agg(F.sum("__n").alias("__n"), F.sum("__rows").alias("__rows"))
    zero = F.array_repeat(F.lit(0.0), dim)
    hits = ex.join(vec, "word", "left").withColumn("__v", F.coalesce("__v", array_to_vector(zero)))
    sums = hits.groupBy(*at).agg(Summarizer.sum(F.col("__v"), F.col("__n")).alias("__s"), F.sum("__rows").alias("__rows"))
    sums = sums.select(*at, vector_to_array(F.col("__s")).alias("__sum"), "__rows")
    r = join_content(d, sums, key).withColumn("__total", F.coalesce(F.transform("__sum", lambda x: x / F.col("__rows")), zero))
    pooled = F.transform("__total", lambda x: x / (F.size(tokens).cast("double") + F.lit(POOL_EPS)))
    return r.select(key, pooled.alias(out))


def first_pool(df: DataFrame, vectors: DataFrame, dim: int, tokens: str = "tokens", key: str = "id",
               out: str = "pooled", max_broadcast_mb: float = BROADCAST_MB) -> DataFrame:
    """Vector of the first token (zeros when the text is empty or the word has no vector); the vector
    table is broadcast when its count times a row's bytes lies within ``max_broadcast_mb``."""
    first = df.select(key, F.try_element_at(F.col(tokens), F.lit(1)).alias("word"))
    vec = vectors.select("word", "vector")
    if fits_broadcast(vectors.count(), _vector_bytes(vectors), max_broadcast_mb):
        vec = F.broadcast(vec)
    j = first.join(vec, "word", "left")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return j.select(key, F.coalesce(F.col("vector"), zero).cast("array<double>").alias(out))
