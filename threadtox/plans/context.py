"""Registered queries: context construction, annotations and per-row projections (P2-P7, P9, P10, J5-J7,
A15, A16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadtox.operators import annotations as A
from threadtox.operators import context as C
from threadtox.operators import features as FE
from threadtox.operators import trees as TR
from threadtox.operators.scoring import MAX_CHARS, char_cap
from threadtox.plans.registry import register
from threadtox.session import scratch_path
from threadtox.sources import files
from threadtox.sources import fixtures as fx

POSITIVE_WEIGHT = 3.0
SENSITIVITY = 0.3


@register("context_concat", "P2", fx.with_fixtures(
    "SELECT id, concat(parent, text) AS context_text, parent || text AS strict_text FROM gc"))
def q_context_concat(spark, d):
    c = fx.comments(spark, d)
    return c.select("id", C.context_concat(F.col("parent"), F.col("text"), "empty").alias("context_text"),
                    C.context_concat(F.col("parent"), F.col("text")).alias("strict_text"))


@register("vocab_augmented", "P3", fx.with_fixtures("SELECT id, text || parent AS vocab_text FROM gc"))
def q_vocab_augmented(spark, d):
    c = fx.comments(spark, d)
    return c.select("id", C.vocabulary_text(F.col("text"), F.col("parent"), augmented=True).alias("vocab_text"))


@register("binarize_target", "P1 P4", fx.with_fixtures(
    "SELECT id, comment_text AS text, target, CAST(round_even(target, 0) AS INTEGER) AS label FROM cctk", "cctk"))
def q_binarize_target(spark, d):
    c = fx.cctk(spark, d)
    return c.select("id", F.col("comment_text").alias("text"), "target", FE.binarize(F.col("target")).alias("label"))


@register("char_cap", "P5", fx.with_fixtures(
    f"SELECT id, substr(text, 1, {MAX_CHARS}) AS capped, length(substr(text, 1, {MAX_CHARS})) AS n_chars FROM gc"))
def q_char_cap(spark, d):
    c = fx.comments(spark, d)
    capped = char_cap(F.col("text"))
    return c.select("id", capped.alias("capped"), F.length(capped).cast("long").alias("n_chars"))


@register("class_weight", "P6", fx.with_fixtures(
    f"SELECT id, label, CASE WHEN label = 1 THEN {POSITIVE_WEIGHT}::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM gc"))
def q_class_weight(spark, d):
    c = fx.comments(spark, d)
    return c.select("id", "label", FE.class_weight(F.col("label"), POSITIVE_WEIGHT).alias("weight"))


@register("label_index", "P7", fx.with_fixtures(
    "SELECT id, CAST(list_position([1, 0], label) - 1 AS INTEGER) AS label_id FROM gc"))
def q_label_index(spark, d):
    c = fx.comments(spark, d)
    return c.select("id", FE.label_index(F.col("label"), [1, 0]).alias("label_id"))


@register("thread_parent", "J5 W3", fx.with_fixtures(
    "SELECT conv_id, turn, role, parent FROM threads", "threads"))
def q_thread_parent(spark, d):
    conv = fx.table(spark, d, "conversations")
    return C.thread_parent(conv).select("conv_id", "turn", "role", "parent")


@register("thread_topic", "J6 W3", fx.with_fixtures(
    "SELECT conv_id, turn, topic FROM threads", "threads"))
def q_thread_topic(spark, d):
    conv = fx.table(spark, d, "conversations")
    return C.thread_topic(conv).select("conv_id", "turn", "topic")


@register("reply_parent", "J5", fx.with_fixtures(
    "SELECT r.id, r.parent_id, p.text AS parent_text FROM replies r LEFT JOIN replies p ON p.id = r.parent_id", "replies"))
def q_reply_parent(spark, d):
    return TR.reply_parent(fx.replies(spark, d)).select("id", "parent_id", "parent_text")


@register("reply_topic", "J6", fx.with_fixtures(
    """WITH tree(id, root_id, depth) AS (SELECT id, id, 0 FROM replies WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM replies)
       UNION ALL SELECT r.id, t.root_id, t.depth + 1 FROM replies r JOIN tree t ON r.parent_id = t.id)
       SELECT r.id, t.root_id, t.depth, r.parent_id IS NOT NULL AND r.parent_id NOT IN (SELECT id FROM replies) AS orphan,
              t.id IS NULL AS cyclic, p.text AS topic
       FROM replies r LEFT JOIN tree t ON t.id = r.id LEFT JOIN replies p ON p.id = t.root_id""", "replies").replace("WITH ", "WITH RECURSIVE ", 1))
def q_reply_topic(spark, d):
    return TR.reply_topic(fx.replies(spark, d))


@register("context_delta", "J7", fx.with_fixtures(
    """SELECT gn.id, gn.label AS label_oc, gc.label AS label_ic, gc.label - gn.label AS delta
       FROM gn JOIN gc ON gn.id = gc.id""", "gn"))
def q_context_delta(spark, d):
    return C.context_delta(fx.comments_gn(spark, d), fx.comments(spark, d))


_UNIFY = "list_transform({c}, lambda x: CASE WHEN x IN ('TOXIC', 'VERY TOXIC') THEN 'TOXIC' ELSE x END)"


@register("unify_codes", "P9", fx.with_fixtures(
    f"SELECT id, {_UNIFY.format(c='tox_codes_oc')} AS codes_oc, {_UNIFY.format(c='tox_codes_ic')} AS codes_ic "
    "FROM annotations", "annotations"))
def q_unify_codes(spark, d):
    a = fx.annotations(spark, d)
    return a.select("id", A.unify(F.col("tox_codes_oc")).alias("codes_oc"),
                    A.unify(F.col("tox_codes_ic")).alias("codes_ic"))


@register("drop_unsure", "P10", fx.with_fixtures(
    """SELECT id, label FROM annotations
       WHERE NOT list_contains(tox_codes_oc, 'UNSURE') AND NOT list_contains(tox_codes_ic, 'UNSURE')""",
    "annotations"))
def q_drop_unsure(spark, d):
    return A.drop_unsure(fx.annotations(spark, d)).select("id", "label")


_TOX = "len(list_filter({c}, lambda x: x IN ('TOXIC', 'VERY TOXIC')))"
_KEPT = ("(SELECT * FROM annotations WHERE NOT list_contains(tox_codes_oc, 'UNSURE') "
         "AND NOT list_contains(tox_codes_ic, 'UNSURE'))")


@register("annotator_rate", "A15", fx.with_fixtures(
    f"""SELECT id, 'oc' AS condition, CAST(len(tox_codes_oc) AS BIGINT) AS n_votes,
               CAST({_TOX.format(c='tox_codes_oc')} AS BIGINT) AS n_toxic,
               {_TOX.format(c='tox_codes_oc')} / len(tox_codes_oc) AS rate FROM {_KEPT}
        UNION ALL
        SELECT id, 'ic' AS condition, CAST(len(tox_codes_ic) AS BIGINT) AS n_votes,
               CAST({_TOX.format(c='tox_codes_ic')} AS BIGINT) AS n_toxic,
               {_TOX.format(c='tox_codes_ic')} / len(tox_codes_ic) AS rate FROM {_KEPT}""", "annotations"))
def q_annotator_rate(spark, d):
    return A.annotator_rate(A.drop_unsure(fx.annotations(spark, d)))


@register("context_sensitivity", "A16", fx.with_fixtures(
    f"""SELECT id, rate_oc, rate_ic, rate_ic - rate_oc AS delta,
               abs(rate_ic - rate_oc) >= {SENSITIVITY}::DOUBLE - 1e-9::DOUBLE AS sensitive
        FROM (SELECT id, {_TOX.format(c='tox_codes_oc')} / len(tox_codes_oc) AS rate_oc,
                     {_TOX.format(c='tox_codes_ic')} / len(tox_codes_ic) AS rate_ic FROM {_KEPT})""", "annotations"))
def q_context_sensitivity(spark, d):
    return A.context_sensitivity(A.drop_unsure(fx.annotations(spark, d)), SENSITIVITY)


_N_TOXIC = _TOX.format(c="tox_codes_ic")


@register("annotator_votes", "A15", fx.with_fixtures(
    f"""SELECT worker, count(*) AS n_posts, CAST(sum(CAST(toxic AS INTEGER)) AS BIGINT) AS n_toxic, round(avg(CAST(toxic AS DOUBLE)), 9) AS rate,
              round(avg(CASE WHEN post <> 0.5 THEN CAST(toxic = (post > 0.5) AS DOUBLE) END), 9) AS agreement
       FROM (SELECT unnest(workers_ic) AS worker, unnest(tox_codes_ic) IN ('TOXIC', 'VERY TOXIC') AS toxic,
                    {_N_TOXIC} / len(tox_codes_ic) AS post FROM annotation_corpus) GROUP BY worker""", "annotation_corpus"))
def q_annotator_votes(spark, d):
    v = A.annotator_votes(fx.annotation_corpus(spark, d))
    return v.select("worker", "n_posts", "n_toxic", F.round("rate", 9).alias("rate"), F.round("agreement", 9).alias("agreement"))


@register("parent_effect", "A16 A15", fx.with_fixtures(
    f"""SELECT parent, count(*) AS n, round(avg(oc), 9) AS rate_oc, round(avg(ic), 9) AS rate_ic, round(avg(ic - oc), 9) AS delta,
              CAST(count_if(abs(ic - oc) >= {SENSITIVITY}::DOUBLE - 1e-9::DOUBLE) AS BIGINT) AS n_sensitive
       FROM (SELECT CASE WHEN tox_codes_parent IS NULL THEN 'none' WHEN {_TOX.format(c='tox_codes_parent')} / len(tox_codes_parent) >= 0.5 THEN 'toxic'
                         ELSE 'other' END AS parent,
                    {_TOX.format(c='tox_codes_oc')} / len(tox_codes_oc) AS oc, {_N_TOXIC} / len(tox_codes_ic) AS ic FROM annotation_corpus)
       GROUP BY parent""", "annotation_corpus"))
def q_parent_effect(spark, d):
    e = A.parent_effect(fx.annotation_corpus(spark, d), SENSITIVITY)
    return e.select("parent", "n", *(F.round(c, 9).alias(c) for c in ("rate_oc", "rate_ic", "delta")), "n_sensitive")


@register("scan_annotations", "S1 A15", fx.with_fixtures(
    """SELECT id, tox_codes_oc, nullif(text, '') AS text, CAST(toxicity_annotator_count AS INTEGER) AS toxicity_annotator_count, nullif(parent, '') AS parent,
              tox_codes_ic, tox_codes_parent, workers_ic FROM annotation_corpus""", "annotation_corpus"))
def q_scan_annotations(spark, d):
    """The annotated corpus with all its columns, written as CSV and read again."""
    path = scratch_path(spark, "annotations-csv")
    files.write_annotations_csv(fx.annotation_corpus(spark, d), path)
    return files.read_annotations_csv(spark, path)
