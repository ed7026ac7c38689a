"""Input tables of the study, derived by Spark from the given parquet tables.

The given data has documents, labels and conversations but no comment threads with annotator codes or
external scores, so the study's inputs are derived deterministically (md5-based uniforms) — each with a
DuckDB twin in ``SQL`` so the oracles read exactly the same rows.

comments (setting gc)  documents ⋈ labels; parent = previous document of the same source by doc_id
api                    informative external score without context
toxicity_scores        external score of parent + text, keyed by id
comments_gn            same ids, ~5% of labels flipped (annotation without context)
threads                conversations with parent (previous turn) and topic (first turn)
replies                documents as posts that answer other posts by id: a third answers document 0, a third forms threads
                       of 1,000 replies in a row, the rest answers a random earlier post
cctk                   transfer corpus: comment_text, fractional target in {0.0, 0.1, ..., 1.0}
annotation_corpus      the published columns: annotations with the parent's codes and the annotators' ids
annotations            ten annotator codes per post and condition (oc = without parent, ic = with)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadtox.functions.hashing import duckdb_uniform as U
from threadtox.functions.hashing import uniform
from threadtox.functions.text import SPECIAL_TOKENS, word_tokens_sql
from threadtox.operators.ranking import previous_value
from threadtox.operators.text import BROADCAST_MB, fits_broadcast, word_index
from threadtox.session import materialized_once
from threadtox.sources.tables import table

# --- fixed values -------------------------------------------------------------------------------
# Annotator codes of the annotated corpus, in increasing severity.
CODES = ["NON-TOXIC", "UNSURE", "TOXIC", "VERY TOXIC"]
ANNOTATORS = 10
# Share of votes drawn as UNSURE, and toxic-vote probability by (label, condition).
UNSURE_SHARE = 0.001
TOXIC_VOTE = {(1, "ic"): 0.7, (1, "oc"): 0.6, (1, "pa"): 0.55, (0, "ic"): 0.1, (0, "oc"): 0.08, (0, "pa"): 0.3}
# Annotators of the platform.
WORKERS = 60
GN_FLIP = 0.05
# Posts of a thread of the reply trees.
CHAIN = 1000
# -------------------------------------------------------------------------------------------------


def comments(spark: SparkSession, data_dir: str) -> DataFrame:
    """gc comments: id, text, parent, label, api (written once per session: every study query reads it)."""
    return materialized_once(spark, ("comments", data_dir), lambda: _comments(spark, data_dir))


def _comments(spark: SparkSession, data_dir: str) -> DataFrame:
    docs = table(spark, data_dir, "documents").select("doc_id", "text", "source")
    docs = previous_value(docs, ["source"], "doc_id", "text", out="parent")
    lab = table(spark, data_dir, "labels").select("doc_id", "toxic")
    if fits_broadcast(lab.count(), 40, BROADCAST_MB):  # else a document moves once more, with its parent
        lab = F.broadcast(lab)
    c = docs.join(lab, "doc_id").select(F.col("doc_id").alias("id"), "text", "parent",
                                        F.col("toxic").cast("int").alias("label"))
    api = F.round(F.lit(0.7) * uniform(F.col("text"))
                  + F.lit(0.3) * F.col("label") * uniform(F.concat(F.lit("b"), F.col("text"))), 3)
    return c.withColumn("api", api)


def _flip_gn(label, id_col):
    flip = uniform(F.concat(F.lit("gn:"), id_col.cast("string"))) < F.lit(GN_FLIP)
    return F.when(flip, F.lit(1) - label).otherwise(label)


def comments_gn(spark: SparkSession, data_dir: str) -> DataFrame:
    """gn comments: the same rows with ~5% of the labels flipped."""
    c = comments(spark, data_dir)
    return c.withColumn("label", _flip_gn(F.col("label"), F.col("id")))


def comment_settings(spark: SparkSession, data_dir: str) -> DataFrame:
    """Both settings in one table with a ``setting`` column (gc, gn), from a single comments plan."""
    c = comments(spark, data_dir).withColumn("setting", F.explode(F.array(F.lit("gc"), F.lit("gn"))))
    return c.withColumn("label", F.when(F.col("setting") == "gn", _flip_gn(F.col("label"), F.col("id")))
                        .otherwise(F.col("label")))


def toxicity_scores(spark: SparkSession, data_dir: str) -> DataFrame:
    """External score computed with the parent (id, TOXICITY)."""
    c = comments(spark, data_dir)
    s = F.round(F.lit(0.6) * uniform(F.col("text"))
                + F.lit(0.4) * F.col("label") * uniform(F.concat(F.lit("c"), F.col("text"))), 3)
    return c.select("id", s.alias("TOXICITY"))


def threads(spark: SparkSession, data_dir: str) -> DataFrame:
    """conversations + parent (previous turn) + topic (text of the first turn)."""
    conv = table(spark, data_dir, "conversations").select("conv_id", "turn", "role", "text")
    with_parent = previous_value(conv, ["conv_id"], "turn", "text", out="parent", shift_bits=10)
    # min_by aggregates map-side first, so a hot conversation costs one row per task, not a hot task.
    topics = conv.groupBy("conv_id").agg(F.min_by("text", "turn").alias("topic"))
    return with_parent.join(topics, "conv_id", "left")


def replies(spark: SparkSession, data_dir: str) -> DataFrame:
    """Reply trees: id, text, parent_id (null for the first post of a thread)."""
    d = table(spark, data_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    star = F.when(F.col("id") > 0, F.lit(0).cast("long"))
    row = F.when(F.pmod(F.floor(F.col("id") / 3), F.lit(CHAIN)) != 0, F.col("id") - 3)
    earlier = F.floor(uniform(F.concat(F.lit("reply:"), F.col("id").cast("string"))) * F.col("id"))
    return d.withColumn("parent_id", F.when(F.col("id") % 3 == 0, star).when(F.col("id") % 3 == 1, row).otherwise(earlier).cast("long"))


def cctk(spark: SparkSession, data_dir: str) -> DataFrame:
    """Transfer corpus: id, comment_text, target (0.0 .. 1.0 in tenths)."""
    d = table(spark, data_dir, "documents").select("doc_id", "text")
    target = F.floor(uniform(F.concat(F.lit("t"), F.col("doc_id").cast("string"))) * F.lit(11)) / F.lit(10.0)
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("comment_text"), target.alias("target"))


def _codes(cond: str) -> "function":
    def code_for(w):
        v = uniform(F.concat_ws(":", F.col("id").cast("string"), F.lit(cond), w.cast("string")))
        t = F.when(F.col("label") == 1, F.lit(TOXIC_VOTE[(1, cond)])).otherwise(F.lit(TOXIC_VOTE[(0, cond)]))
        return (F.when(v < F.lit(UNSURE_SHARE), F.lit("UNSURE"))
                .when(v < t / F.lit(3.0), F.lit("VERY TOXIC"))
                .when(v < t, F.lit("TOXIC"))
                .otherwise(F.lit("NON-TOXIC")))
    return code_for


def annotations(spark: SparkSession, data_dir: str) -> DataFrame:
    """Annotated corpus: id, text, parent, label, tox_codes_oc, tox_codes_ic, toxicity_annotator_count.

    Code arrays are built in one projection (``transform`` over worker numbers): no explode, no shuffle.
    """
    c = comments(spark, data_dir)
    workers = F.sequence(F.lit(0), F.lit(ANNOTATORS - 1))
    return c.select("id", "text", "parent", "label",
                    F.transform(workers, _codes("oc")).alias("tox_codes_oc"),
                    F.transform(workers, _codes("ic")).alias("tox_codes_ic"),
                    F.lit(ANNOTATORS).alias("toxicity_annotator_count"))


def annotation_corpus(spark: SparkSession, data_dir: str) -> DataFrame:
    """The eight columns of the annotated corpus: annotations, tox_codes_parent (null without a parent) and workers_ic."""
    workers = F.sequence(F.lit(0), F.lit(ANNOTATORS - 1))
    worker = lambda w: F.floor(uniform(F.concat_ws(":", F.lit("w"), F.col("id").cast("string"), w.cast("string"))) * WORKERS).cast("long")
    return annotations(spark, data_dir).select(
        "id", "tox_codes_oc", "text", "toxicity_annotator_count", "parent", "tox_codes_ic",
        F.when(F.col("parent").isNotNull(), F.transform(workers, _codes("pa"))).alias("tox_codes_parent"),
        F.transform(workers, worker).alias("workers_ic"))


def word_vectors(spark: SparkSession, data_dir: str) -> DataFrame:
    """word, vector: the vocabulary word with id k gets the embedding row vec_id = k - 1 (later words none).
    Written once per session: it rests on the full vocabulary ranking, which its readers would redo."""
    return materialized_once(spark, ("word_vectors", data_dir), lambda: _word_vectors(spark, data_dir))


def vocabulary(spark: SparkSession, data_dir: str) -> DataFrame:
    """word, word_id, freq: the ranked vocabulary of the comments (written once per session; word vectors
    and the pair vocabulary are both built on it)."""
    return materialized_once(spark, ("vocabulary", data_dir), lambda: word_index(comments(spark, data_dir)))


def _word_vectors(spark: SparkSession, data_dir: str) -> DataFrame:
    wi = vocabulary(spark, data_dir)
    emb = table(spark, data_dir, "embeddings").select((F.col("vec_id") + F.lit(1)).alias("word_id"),
                                                      F.col("embedding").alias("vector"))
    return wi.join(emb, "word_id").select("word", "vector")


def pair_vocab(spark: SparkSession, data_dir: str) -> DataFrame:
    """token, token_id: the special tokens (ids 0..3), then the ranked words of the comments (written once
    per session, like word_vectors)."""
    return materialized_once(spark, ("pair_vocab", data_dir), lambda: _pair_vocab(spark, data_dir))


def _pair_vocab(spark: SparkSession, data_dir: str) -> DataFrame:
    spark_specials = spark.createDataFrame([(t, i) for i, t in enumerate(SPECIAL_TOKENS)], "token string, token_id long")
    wi = vocabulary(spark, data_dir).select(
        F.col("word").alias("token"), (F.col("word_id") + F.lit(len(SPECIAL_TOKENS) - 1)).alias("token_id"))
    return spark_specials.unionByName(wi)


# --- DuckDB twins (CTE bodies) ---------------------------------------------------------------------

def _code_sql(cond: str) -> str:
    v = U(f"concat_ws(':', id, '{cond}', w)")
    t = f"(CASE WHEN label = 1 THEN {TOXIC_VOTE[(1, cond)]}::DOUBLE ELSE {TOXIC_VOTE[(0, cond)]}::DOUBLE END)"
    return (f"list_transform(range({ANNOTATORS}), lambda w: CASE WHEN {v} < {UNSURE_SHARE}::DOUBLE THEN 'UNSURE' "
            f"WHEN {v} < {t} / 3.0::DOUBLE THEN 'VERY TOXIC' WHEN {v} < {t} THEN 'TOXIC' ELSE 'NON-TOXIC' END)")


SQL = {
    "gc": f"""SELECT d.doc_id AS id, d.text, d.parent, CAST(l.toxic AS INTEGER) AS label,
                 round(0.7::DOUBLE * {U('d.text')} + 0.3::DOUBLE * l.toxic * {U("concat('b', d.text)")}, 3) AS api
          FROM (SELECT doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS parent
                FROM documents) d JOIN labels l ON d.doc_id = l.doc_id""",
    "gn": f"""SELECT id, text, parent,
                 CASE WHEN {U("concat('gn:', id)")} < {GN_FLIP}::DOUBLE THEN 1 - label ELSE label END AS label, api
          FROM gc""",
    "settings": "SELECT *, 'gc' AS setting FROM gc UNION ALL SELECT *, 'gn' AS setting FROM gn",
    "toxicity_scores": f"""SELECT id, round(0.6::DOUBLE * {U('text')} + 0.4::DOUBLE * label * {U("concat('c', text)")}, 3)
                            AS TOXICITY FROM gc""",
    "threads": """SELECT conv_id, turn, role, text,
                     lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS parent,
                     first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS topic
                  FROM conversations""",
    "replies": f"""SELECT doc_id AS id, text, CAST(CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id > 0 THEN 0 END
                      WHEN doc_id % 3 = 1 THEN CASE WHEN (doc_id // 3) % {CHAIN} <> 0 THEN doc_id - 3 END
                      ELSE floor({U("concat('reply:', doc_id)")} * doc_id) END AS BIGINT) AS parent_id FROM documents""",
    "cctk": f"""SELECT doc_id AS id, text AS comment_text,
                   floor({U("concat('t', doc_id)")} * 11) / 10.0::DOUBLE AS target FROM documents""",
    "annotations": f"""SELECT id, text, parent, label, {_code_sql('oc')} AS tox_codes_oc,
                          {_code_sql('ic')} AS tox_codes_ic, {ANNOTATORS} AS toxicity_annotator_count FROM gc""",
    "annotation_corpus": f"""SELECT id, tox_codes_oc, text, toxicity_annotator_count, parent, tox_codes_ic,
                          CASE WHEN parent IS NOT NULL THEN {_code_sql('pa')} END AS tox_codes_parent,
                          list_transform(range({ANNOTATORS}), lambda w: CAST(floor({U("concat_ws(':', 'w', id, w)")} * {WORKERS}) AS BIGINT)) AS workers_ic
                          FROM annotations""",
    "word_index": f"""SELECT word, row_number() OVER (ORDER BY freq DESC, fk) AS word_id, freq FROM (
                        SELECT word, count(*) AS freq, min(id * 10000000 + pos) AS fk FROM (
                          SELECT id, unnest(tk) AS word, generate_subscripts(tk, 1) AS pos
                          FROM (SELECT id, {word_tokens_sql('text')} AS tk FROM gc)) GROUP BY word)""",
    "word_vectors": "SELECT w.word, e.embedding AS vector FROM word_index w JOIN embeddings e ON e.vec_id = w.word_id - 1",
    "pair_vocab": ("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(SPECIAL_TOKENS))
                   + f") v(token, token_id) UNION ALL SELECT word AS token, word_id + {len(SPECIAL_TOKENS) - 1} AS token_id "
                   "FROM word_index"),
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix a query with the CTEs it needs (gc always comes first: the others read it)."""
    order = ["gc", "gn", "settings", "toxicity_scores", "threads", "replies", "cctk", "annotations", "annotation_corpus", "word_index",
             "word_vectors", "pair_vocab"]
    need = set(names) | {"gc"}
    if "settings" in need:
        need.add("gn")
    if "annotation_corpus" in need:
        need.add("annotations")
    if need & {"word_vectors", "pair_vocab"}:
        need.add("word_index")
    ctes = [f"{n} AS ({SQL[n]})" for n in order if n in need]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
