"""Registered queries: tokens, vocabulary, id sequences, padding, word vectors and pooling (F1, F2, A5, A6,
W1, J2, J3, S5, A13, A14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadtox.functions.text import pad_pre, pad_pre_sql, word_tokens, word_tokens_sql
from threadtox.operators import text as T
from threadtox.operators.context import vocabulary_text
from threadtox.plans.evaluation import split_text, with_splits
from threadtox.plans.registry import register
from threadtox.plans.sql import split_table_sql
from threadtox.session import materialized_once, scratch_path
from threadtox.sources import fixtures as fx

SEQ_LEN = 512   # tokens the study's recurrent classifier reads
R6 = 6


@register("word_tokens", "F1", fx.with_fixtures(f"SELECT id, {word_tokens_sql('text')} AS tokens FROM gc"))
def q_word_tokens(spark, d):
    return fx.comments(spark, d).select("id", word_tokens(F.col("text")).alias("tokens"))


@register("word_counts", "A5", fx.with_fixtures(
    f"SELECT word, count(*) AS freq FROM (SELECT unnest({word_tokens_sql('text')}) AS word FROM gc) GROUP BY word"))
def q_word_counts(spark, d):
    return T.word_counts(fx.comments(spark, d))


@register("word_index", "W1", fx.with_fixtures("SELECT word, word_id, freq FROM word_index", "word_index"))
def q_word_index(spark, d):
    return T.word_index(fx.comments(spark, d))


@register("vocab_size", "A6", fx.with_fixtures(
    "SELECT CAST(max(word_id) + 1 AS BIGINT) AS vocab_size, CAST(max(word_id) + 3 AS BIGINT) AS embedding_rows "
    "FROM word_index", "word_index"))
def q_vocab_size(spark, d):
    return T.vocab_size(fx.vocabulary(spark, d))


def _train_vocab(spark, d):
    """Vocabulary of the first training part (written once per session: sequences and padding share it)."""
    def build():
        return T.word_index(split_text(spark, d, 0, "gc", "train"))
    return materialized_once(spark, ("train_vocab", d), build)


_TRAIN_VOCAB_SQL = f"""train_vocab AS (
    SELECT word, row_number() OVER (ORDER BY freq DESC, fk) AS word_id FROM (
      SELECT word, count(*) AS freq, min(id * 10000000 + pos) AS fk FROM (
        SELECT id, unnest(tk) AS word, generate_subscripts(tk, 1) AS pos
        FROM (SELECT id, {word_tokens_sql('text')} AS tk FROM split_table
              WHERE setting = 'gc' AND split = 0 AND part = 'train')) GROUP BY word)),
  seqs AS (
    SELECT g.id, COALESCE(s.seq, []) AS seq FROM gc g LEFT JOIN (
      SELECT t.id, list(v.word_id ORDER BY t.pos) AS seq FROM (
        SELECT id, unnest(tk) AS word, generate_subscripts(tk, 1) AS pos
        FROM (SELECT id, {word_tokens_sql('text')} AS tk FROM gc)) t
      JOIN train_vocab v ON t.word = v.word GROUP BY t.id) s ON g.id = s.id)"""


@register("texts_to_sequences", "J3", with_splits(f"WITH {_TRAIN_VOCAB_SQL} SELECT id, seq FROM seqs"))
def q_texts_to_sequences(spark, d):
    return T.sequences(fx.comments(spark, d), _train_vocab(spark, d), {"text": "seq"})


@register("pad_sequences", "F2", with_splits(
    f"WITH {_TRAIN_VOCAB_SQL} SELECT id, {pad_pre_sql('seq', SEQ_LEN)} AS padded FROM seqs"))
def q_pad_sequences(spark, d):
    s = T.sequences(fx.comments(spark, d), _train_vocab(spark, d), {"text": "seq"})
    return s.select("id", pad_pre(F.col("seq"), SEQ_LEN).alias("padded"))


@register("embedding_lookup", "J2", fx.with_fixtures(
    """SELECT w.word, w.word_id, COALESCE(v.vector, list_transform(range(64), lambda x: 0.0::FLOAT)) AS vector
       FROM word_index w LEFT JOIN word_vectors v ON w.word = v.word""", "word_vectors"))
def q_embedding_lookup(spark, d):
    vec = fx.word_vectors(spark, d)
    e = T.embedding_lookup(fx.vocabulary(spark, d), vec, 64)
    return e.select("word", "word_id", "vector")


@register("scan_word_vectors", "S5", fx.with_fixtures("SELECT word, vector FROM word_vectors", "word_vectors"))
def q_scan_word_vectors(spark, d):
    vec = fx.word_vectors(spark, d)
    lines = vec.select(F.concat_ws(" ", F.col("word"),
                                   F.concat_ws(" ", F.transform("vector", lambda x: x.cast("string")))).alias("value"),
                       F.col("word").alias("__order"))
    return T.parse_word_vectors(lines, order=F.col("__order"))


@register("scan_word_vector_file", "S5", fx.with_fixtures("SELECT word, vector FROM word_vectors", "word_vectors"))
def q_scan_word_vector_file(spark, d):
    """The vectors from text files in which every word stands twice, first with zeros: its last line wins."""
    def line(vector):
        return F.concat_ws(" ", "word", F.concat_ws(" ", F.transform(vector, lambda x: x.cast("string"))))
    twice = fx.word_vectors(spark, d).select("word", F.explode(F.array(
        F.struct(F.lit(0).alias("k"), line(F.transform("vector", lambda x: x * 0)).alias("value")),
        F.struct(F.lit(1).alias("k"), line(F.col("vector")).alias("value")))).alias("l"))
    path = scratch_path(spark, "word-vectors")
    # a word's two lines lie in one file, the zeros first
    twice.repartition(4, "word").sortWithinPartitions("l.k", "word").select("l.value").write.text(path)
    return T.read_word_vectors(spark, path)


def _augmented_vocab(spark, d):
    """Vocabulary over text followed by parent, as the context-aware classifiers fit it."""
    def build():
        train = split_text(spark, d, 0, "gc", "train")
        return T.word_index(train.select("id", vocabulary_text(F.col("text"), F.col("parent"), augmented=True).alias("text")))
    return materialized_once(spark, ("augmented_vocab", d), build)


def _branch_sql(col: str) -> str:
    return f"""(SELECT t.id, list(v.word_id ORDER BY t.pos) AS seq FROM (
        SELECT id, unnest(tk) AS word, generate_subscripts(tk, 1) AS pos
        FROM (SELECT id, COALESCE({word_tokens_sql(col)}, []) AS tk FROM gc)) t
      JOIN augmented_vocab v ON t.word = v.word GROUP BY t.id)"""


@register("parent_sequences", "P3 J3 F2", with_splits(
    f"""WITH augmented_vocab AS (
    SELECT word, row_number() OVER (ORDER BY freq DESC, fk) AS word_id FROM (
      SELECT word, count(*) AS freq, min(id * 10000000 + pos) AS fk FROM (
        SELECT id, unnest(tk) AS word, generate_subscripts(tk, 1) AS pos
        FROM (SELECT id, COALESCE({word_tokens_sql('text || parent')}, []) AS tk FROM split_table
              WHERE setting = 'gc' AND split = 0 AND part = 'train')) GROUP BY word))
    SELECT g.id, {pad_pre_sql('COALESCE(a.seq, [])', SEQ_LEN)} AS text_seq, {pad_pre_sql('COALESCE(b.seq, [])', SEQ_LEN)} AS parent_seq
    FROM gc g LEFT JOIN {_branch_sql('text')} a ON a.id = g.id LEFT JOIN {_branch_sql('parent')} b ON b.id = g.id"""))
def q_parent_sequences(spark, d):
    """Both branches of the context-aware classifiers: text and parent encoded with one augmented vocabulary."""
    s = T.sequences(fx.comments(spark, d), _augmented_vocab(spark, d), {"text": "a", "parent": "b"})
    return s.select("id", pad_pre(F.col("a"), SEQ_LEN).alias("text_seq"), pad_pre(F.col("b"), SEQ_LEN).alias("parent_seq"))


_POOL_SQL = f"""WITH toks AS (SELECT id, {word_tokens_sql('text')} AS tk FROM gc),
  hits AS (SELECT t.id, v.vector FROM (SELECT id, unnest(tk) AS word FROM toks) t JOIN word_vectors v ON t.word = v.word),
  dims AS (SELECT id, generate_subscripts(vector, 1) AS dim, unnest(vector) AS x FROM hits),
  sums AS (SELECT id, list(s ORDER BY dim) AS sv FROM (SELECT id, dim, SUM(CAST(x AS DOUBLE)) AS s FROM dims GROUP BY id, dim)
           GROUP BY id)
  SELECT t.id, list_transform(COALESCE(s.sv, list_transform(range(64), lambda x: 0.0::DOUBLE)),
                              lambda x: round(x / (len(t.tk) + 1e-10::DOUBLE), {R6})) AS pooled
  FROM toks t LEFT JOIN sums s ON t.id = s.id"""


@register("masked_mean_pool", "A13", fx.with_fixtures(_POOL_SQL, "word_vectors"))
def q_masked_mean_pool(spark, d):
    toks = T.tokenize(fx.comments(spark, d))
    p = T.masked_mean_pool(toks, fx.word_vectors(spark, d), 64)
    return p.select("id", F.transform("pooled", lambda x: F.round(x, R6)).alias("pooled"))


@register("first_pool", "A14", fx.with_fixtures(
    f"""SELECT g.id, COALESCE(CAST(v.vector AS DOUBLE[]), list_transform(range(64), lambda x: 0.0::DOUBLE)) AS pooled
        FROM (SELECT id, {word_tokens_sql('text')}[1] AS word FROM gc) g LEFT JOIN word_vectors v ON g.word = v.word""",
    "word_vectors"))
def q_first_pool(spark, d):
    toks = T.tokenize(fx.comments(spark, d))
    return T.first_pool(toks, fx.word_vectors(spark, d), 64)
