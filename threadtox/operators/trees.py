"""Reply trees: posts that name the post they answer.

The parent is one lookup by id. The root and the depth come from pointer doubling: every post points to its parent; in
each round it points to what its target points to, and adds the target's steps to its own. After k rounds all posts of
depth 2^k or less have arrived, so a thread of a thousand replies in a row takes ten rounds, and a star takes one. Each
round is written to the checkpoint folder: the plan stays short and a lost executor repeats one round at most. Targets
that many posts share (the root of a star) are looked up without a shuffle (:func:`lookup_join`).

Defined results: a post without a parent, or whose parent is not in the table, is a root of depth 0 (the latter is
flagged ``orphan``). Posts of a cycle, and those that hang on one, have no root and no depth and are flagged ``cyclic``:
a round in which no post arrives proves that the rest never will. Of repeated ids the smallest parent counts; posts with
a null id are no part of a tree. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadtox.operators.skew import lookup_join
from threadtox.session import materialize


def reply_parent(posts: DataFrame, columns: Sequence[str] = ("text",), key: str = "id", parent: str = "parent_id", prefix: str = "parent_") -> DataFrame:
    """``posts`` with ``columns`` of the post that each answers, as ``prefix + column`` (null for roots and orphans)."""
    of = posts.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.min(F.struct(*columns)).alias("__of"))
    found = lookup_join(posts, of, parent, "__id")
    return found.select(*posts.columns, *(F.col("__of")[c].alias(prefix + c) for c in columns))


def reply_tree(posts: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id, root_id, depth, orphan, cyclic): one row for each id of ``posts``."""
    edges = materialize(posts.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(parent).alias("up")), "edges")
    known = lookup_join(edges, edges.select(F.col("id").alias("to"), F.lit(True).alias("there")), "up", "to")
    orphan = F.col("up").isNotNull() & F.col("there").isNull()
    # up: where the post points to, null once it has arrived at its root
    state = materialize(known.select("id", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("there"), 1).otherwise(0).alias("steps"),
                                     F.when(F.col("there").isNull(), F.col("id")).alias("root"), orphan.alias("orphan")), "tree")
    left = state.filter("up IS NOT NULL").count()
    while left:
        target = state.select(F.col("id").alias("to"), F.col("up").alias("on"), F.col("steps").alias("more"), F.col("root").alias("at"))
        moved = lookup_join(state.filter("up IS NOT NULL"), target, "up", "to") \
            .select("id", F.col("on").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("at").alias("root"), "orphan")
        state = materialize(state.filter("up IS NULL").unionByName(moved), "tree")
        before, left = left, state.filter("up IS NOT NULL").count()
        if left == before:
            break  # nobody arrived: what is left runs in circles
    return state.select("id", F.col("root").alias("root_id"), F.when(F.col("up").isNull(), F.col("steps")).alias("depth"),
                        "orphan", F.col("up").isNotNull().alias("cyclic"))


def reply_topic(posts: DataFrame, text: str = "text", key: str = "id", parent: str = "parent_id", out: str = "topic") -> DataFrame:
    """(id, root_id, depth, orphan, cyclic, topic): the tree with the text of each post's root."""
    tree = materialize(reply_tree(posts, key, parent), "tree")
    of = posts.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.min(text).alias(out))
    return lookup_join(tree, of, "root_id", "__id")
