"""Context construction: parent/topic of each reply, text + context concatenation, context effect on labels.

Thread positions are joined, not windowed: the parent of turn t is found by an equi-join on
(conversation, rank - 1), so one enormous thread is spread over many tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadtox.operators.ranking import previous_value


def context_concat(parent: Column, text: Column, null_parent: str = "null") -> Column:
    """parent immediately followed by text (no separator). A null parent gives null (``null_parent='null'``,
    the study's behaviour) or just the text (``'empty'``)."""
    p = F.coalesce(parent, F.lit("")) if null_parent == "empty" else parent
    return F.concat(p, text)


def vocabulary_text(text: Column, parent: Column, augmented: bool) -> Column:
    """Text the vocabulary is fitted on: the text alone, or text followed by parent when augmented."""
    return F.concat(text, parent) if augmented else text


def thread_parent(posts: DataFrame, thread: str = "conv_id", position: str = "turn", text: str = "text",
                  out: str = "parent", shift_bits: int = 10) -> DataFrame:
    """Previous post of the same thread (null for the first)."""
    return previous_value(posts, [thread], position, text, out=out, shift_bits=shift_bits)


def thread_topic(posts: DataFrame, thread: str = "conv_id", position: str = "turn", text: str = "text",
                 out: str = "topic") -> DataFrame:
    """Text of the first post of the thread, attached to every post of it. ``min_by`` is aggregated
    map-side, and the join back is a many-to-one equi-join (AQE splits a hot thread's partition)."""
    first = posts.groupBy(thread).agg(F.min_by(F.col(text), F.col(position)).alias(out))
    return posts.join(first, thread, "left")


def context_delta(out_of_context: DataFrame, in_context: DataFrame, key: str = "id",
                  label: str = "label") -> DataFrame:
    """Per comment, the label without context, with context, and their difference (ic - oc)."""
    oc = out_of_context.select(F.col(key), F.col(label).alias("label_oc"))
    ic = in_context.select(F.col(key), F.col(label).alias("label_ic"))
    return oc.join(ic, key).withColumn("delta", F.col("label_ic") - F.col("label_oc"))
