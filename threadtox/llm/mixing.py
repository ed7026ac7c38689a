"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source's weight is its share of all tokens to the power ``alpha`` (1: as is, 0: all alike), normalised. ``alpha``
is found by bisection: the largest one whose weights reach ``target_entropy`` (a share of the highest possible), or,
where that would repeat a source more than ``max_repeat`` times, the smallest one that does not. A source's part of
the budget is whole passes over its documents and a rest. Every pass is a permutation: documents are dealt into
blocks of about ``block_docs`` by hash, blocks are ordered by a hash of (seed, pass, block), documents within a block
by a hash of (seed, pass, document). The rest of the budget takes documents in that order while they fit.

Only sums by source reach the driver (one row a source, at most ``max_sources``). Running totals run over blocks, and
over documents only inside a block, so a source with a third of all documents is spread over its blocks.

Defined results: a token is a run of characters without ASCII white space. A null text has no tokens and a null
source counts as the source ''. Rows are documents: repeated rows are each drawn once a pass, in no given order among
themselves. Very long texts are counted whole. Sources without tokens get no rows; without any token, or with an empty table, the result is empty. Other
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadtox.llm.rows import materialize, typed

STEPS = 40


@dataclass(frozen=True)
class Mixture:
    alpha: float
    weights: dict[str, float]
    quotas: dict[str, int]


def weights_at(tokens: dict[str, int], alpha: float) -> dict[str, float]:
    total = sum(tokens.values())
    w = {s: (n / total) ** alpha for s, n in sorted(tokens.items()) if n > 0}
    norm = math.fsum(w.values())
    return {s: x / norm for s, x in w.items()}


def entropy(weights: dict[str, float]) -> float:
    return -math.fsum(x * math.log(x) for x in weights.values() if x > 0)


def solve(tokens: dict[str, int], budget: int, target_entropy: float, max_repeat: float) -> Mixture:
    """Bisect alpha in [0, 1] for the entropy, then for the repetition limit."""
    tokens = {s: n for s, n in tokens.items() if n > 0}
    if not tokens or budget <= 0:
        return Mixture(1.0, {}, {})

    def bisect(low_ok) -> float:
        """The border between alphas where low_ok holds (below) and where it does not, from 0 to 1."""
        lo, hi = 0.0, 1.0
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if low_ok(mid) else (lo, mid)
        return (lo + hi) / 2

    need = target_entropy * math.log(len(tokens))
    alpha = 1.0 if entropy(weights_at(tokens, 1.0)) >= need else bisect(lambda a: entropy(weights_at(tokens, a)) >= need)

    def repeats(a: float) -> float:
        return max(budget * w / tokens[s] for s, w in weights_at(tokens, a).items())

    if repeats(alpha) > max_repeat:
        alpha = 1.0 if repeats(1.0) > max_repeat else max(alpha, bisect(lambda a: repeats(a) > max_repeat))
    weights = weights_at(tokens, alpha)
    return Mixture(alpha, weights, {s: int(math.floor(w * budget + 1e-6)) for s, w in weights.items()})


def _hash(*parts):
    """The first 60 bits of an md5 over the parts, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float = 0.98, max_repeat: float = 2.0, seed: int = 1,
        block_docs: int = 1000, max_sources: int = 100_000) -> DataFrame:
    """(doc_id, source, epoch, block_rank, place, n_tokens): the drawn documents; epoch, block_rank and place from 1.

    Read in the order of epoch, block_rank, place within each source. ``budget`` in tokens (default: all there are).
    """
    sized = materialize(typed(docs, doc_id="long", source="string", text="string").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long").alias("n_tokens")), "sized")
    sums = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    rows = sums.limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    total = sum(r.tokens for r in rows)
    mixture = solve({r.source: r.tokens for r in rows}, total if budget is None else budget, target_entropy, max_repeat)
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(r.source, -(-r.docs // block_docs), mixture.quotas[r.source] // r.tokens, mixture.quotas[r.source] % r.tokens)
         for r in rows if mixture.quotas.get(r.source)], "source string, blocks long, full long, rest long")
    drawn = sized.join(F.broadcast(plan), "source") \
        .withColumn("block", F.pmod(_hash(F.lit(seed), F.col("doc_id")), F.col("blocks"))) \
        .withColumn("epoch", F.explode(F.expr("sequence(1L, full + if(rest > 0, 1L, 0L))")))
    # blocks of each pass in order, with the tokens before them
    blocks = drawn.groupBy("source", "epoch", "block", "full", "rest").agg(F.sum("n_tokens").alias("tokens"))
    order = Window.partitionBy("source", "epoch").orderBy(_hash(F.lit(seed), F.col("epoch"), F.col("block")), "block")
    blocks = blocks.withColumn("block_rank", F.row_number().over(order).cast("long")) \
        .withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))) \
        .select("source", "epoch", "block", "block_rank", F.coalesce("before", F.lit(0)).alias("before")) 
    inside = Window.partitionBy("source", "epoch", "block").orderBy(_hash(F.lit(seed), F.col("epoch"), F.col("doc_id")), "doc_id", "n_tokens")
    placed = drawn.withColumn("place", F.row_number().over(inside).cast("long")) \
        .withColumn("so_far", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.join(blocks, ["source", "epoch", "block"]) \
        .filter("epoch <= full OR before + so_far <= rest") \
        .select("doc_id", "source", "epoch", "block_rank", "place", "n_tokens")
