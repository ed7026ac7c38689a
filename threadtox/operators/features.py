"""Row-level feature preparation: label handling, class weights, pair features for sequence-pair encoders.

Everything is a projection (array functions on JVM-side columns) except the WordPiece split, which
lives in :mod:`threadtox.operators.wordpiece`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadtox.functions.text import SPECIAL_TOKENS, pad_post, pair_budget
from threadtox.operators.text import tokens_to_ids


def binarize(target: Column) -> Column:
    """Fractional label -> 0/1 with half-to-even rounding (0.5 -> 0, 1.5 -> 2)."""
    return F.bround(target, 0).cast("int")


def class_weight(label: Column, positive_weight: float) -> Column:
    """Per-row weight {0: 1, 1: positive_weight} for a weighted loss."""
    return F.when(label == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0))


def label_index(label: Column, label_list: Sequence) -> Column:
    """Position of the label in ``label_list`` (0-based); a label outside the list fails the job."""
    arr = F.array(*[F.lit(v) for v in label_list])
    pos = F.array_position(arr, label)
    return F.when(pos > 0, pos - F.lit(1)).otherwise(
        F.raise_error(F.concat(F.lit("label not in label list: "), label.cast("string")))).cast("int")


def truncate_single(tokens: Column, max_len: int) -> Column:
    """First ``max_len - 2`` tokens (room for the two markers)."""
    return F.slice(tokens, 1, max_len - 2)


def truncate_pair(tokens_a: Column, tokens_b: Column, max_len: int) -> tuple[Column, Column]:
    """Both sides cut so that a + b <= max_len - 3, always shortening the longer side (ties cut b)."""
    ka, kb = pair_budget(F.size(tokens_a), F.size(tokens_b), max_len - 3)
    return F.slice(tokens_a, 1, ka), F.slice(tokens_b, 1, kb)


def pair_features(df: DataFrame, vocab: DataFrame, tokens_a: str, tokens_b: str | None, max_len: int,
                  label: str = "label", label_list: Sequence = (0, 1), key: str = "id",
                  unknown: str = SPECIAL_TOKENS[1]) -> DataFrame:
    """Encoder inputs for (text_a, optional text_b): input_ids, input_mask, segment_ids (each padded to
    ``max_len``), label_id and is_real_example.

    A missing or empty ``tokens_b`` falls back to the single-sequence form. Tokens get their id of
    ``vocab(token, token_id)`` after the cut; tokens the vocabulary lacks map to the id of ``unknown``.
    """
    cls, sep = F.lit(SPECIAL_TOKENS[2]), F.lit(SPECIAL_TOKENS[3])
    empty = F.array().cast("array<string>")
    a = F.coalesce(F.col(tokens_a), empty)
    b = F.coalesce(F.col(tokens_b), empty) if tokens_b else empty
    has_b = F.size(b) > 0
    ta, tb = truncate_pair(a, b, max_len)
    single = truncate_single(a, max_len)
    tokens = F.when(has_b, F.concat(F.array(cls), ta, F.array(sep), tb, F.array(sep))) \
        .otherwise(F.concat(F.array(cls), single, F.array(sep)))
    n_a = F.when(has_b, F.size(ta)).otherwise(F.size(single))
    n_b = F.when(has_b, F.size(tb) + F.lit(1)).otherwise(F.lit(0))
    base = df.select(F.col(key), tokens.alias("__tokens"), n_a.alias("__na"), n_b.alias("__nb"),
                     label_index(F.col(label), label_list).alias("label_id"))
    unk = vocab.where(F.col("token") == F.lit(unknown)).select(F.min("token_id").cast("long")).scalar()
    ids = tokens_to_ids(base, vocab, "__tokens", "__ids", key=key, word="token", index="token_id", unknown_id=unk, keep_tokens=False)
    zero = 0
    segments = F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("__na") + F.lit(2)),
                        F.array_repeat(F.lit(1).cast("long"), F.col("__nb")))
    return ids.select(
        F.col(key),
        pad_post(F.col("__ids"), max_len, zero).alias("input_ids"),
        pad_post(F.array_repeat(F.lit(1).cast("long"), F.size(F.col("__ids"))), max_len, zero).alias("input_mask"),
        pad_post(segments, max_len, zero).alias("segment_ids"),
        F.col("label_id"),
        F.lit(True).alias("is_real_example"))
