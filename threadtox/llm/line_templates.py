"""Line dedup with a log-template tree, in DataFrame functions only.

A line is its sequence of tokens: lines that differ in white space alone are one line. Lines are parsed to a fixed depth:
token count, then the first ``depth`` tokens, where a token with a digit counts as the variable ``<*>``. Within such a leaf
a token is constant at its place if the lines that have it there stand ``min_docs`` times in documents, else it is a
variable field too. A line's template is its tokens with the variable ones as ``<*>``; it counts as a template if at least
``min_share`` percent of its tokens are constant, or ``lead_share`` percent where the first two are. A template that
recurs in ``min_docs`` documents or more stays in the document with the smallest ``doc_id`` and is dropped from all
others, so nothing vanishes from the corpus as a whole. Apart from that an unchanged line is its own template, digits and
all; for lines of ``long_tokens`` tokens or more ``long_docs`` documents are enough: a long passage is no chance repeat.
Long lines that are only alike go by the first rule, from ``min_docs`` documents on.

Texts are split and hashed once, and (document, line) written. Everything is decided on the distinct lines: their
documents are counted, pre-aggregated before the shuffle, so a line of a third of all documents is one row a task; only
lines of leaves that recur are parsed into tokens, each once; templates and decisions are rows by distinct line. Joins back
to (document, line) broadcast the lines decided on if a count shows at most ``max_broadcast`` of them (16 bytes each);
else they are shuffle joins, in which the lines of a thousandth of all rows or more (a thousand lines at most) are salted.

Defined results: a null text stays null, without lines; an empty text stays empty. Lines without tokens are never
dropped. Rows with a null ``doc_id`` stay as they are and do not count. Repeated rows of a ``doc_id`` are one
document. Very long texts and lines are read whole. All columns of ``docs`` come back, only ``text`` changes; with counts,
columns named ``n_lines`` and ``n_dropped`` are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadtox.llm.rows import materialize

SALTS = 64


def _plain(text: Column) -> Column:
    """White space other than line ends as blanks."""
    for c in ("\t", "\x0b", "\f", "\r"):
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _id(tokens: Column) -> Column:
    return F.xxhash64(F.array_join(tokens, " "))


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))


def lines_of(docs: DataFrame, depth: int) -> DataFrame:
    """(doc, id, leaf, n_tokens, line): the lines of each row that have tokens, with hashes of the line and its leaf."""
    lines = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL") \
        .select(F.col("doc_id").alias("doc"), F.explode(F.split(_plain(F.col("text")), "\n")).alias("line")) \
        .select("doc", _tokens(F.col("line")).alias("tokens")).filter(F.size("tokens") > 0)
    lead = _masked(F.slice("tokens", 1, depth))
    return lines.select("doc", F.array_join("tokens", " ").alias("line"), F.size("tokens").alias("n_tokens"),
                        F.xxhash64(F.size("tokens"), F.concat_ws(" ", lead)).alias("leaf")).withColumn("id", F.xxhash64("line"))


def _at(lines: DataFrame, decided: DataFrame, kinds: DataFrame, max_broadcast: int) -> DataFrame:
    """``lines`` (doc, id) joined with the rows of ``decided`` (id, ...; one row an id) by id."""
    decided = materialize(decided, "decided")
    if decided.count() <= max_broadcast:
        return lines.join(F.broadcast(decided), "id")
    total = kinds.agg(F.sum("docs")).first()[0] or 0
    hot = kinds.filter(F.col("docs") * 1000 > total).select("id", F.lit(SALTS).alias("salts"))  # fewer than a thousand
    salt = F.pmod(F.xxhash64("doc"), F.coalesce("salts", F.lit(1)))
    left = lines.join(F.broadcast(hot), "id", "left").withColumn("salt", salt.cast("int")).drop("salts")
    right = decided.join(F.broadcast(hot), "id", "left") \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, ["id", "salt"]).drop("salt")


def templates(lines: DataFrame, kinds: DataFrame, depth: int, min_docs: int, min_share: int, lead_share: int, max_broadcast: int) -> DataFrame:
    """(id, template, docs, holder, n_tokens, n_constant) of every distinct line that has a template."""
    leaves = materialize(kinds.groupBy("leaf").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("leaf"), "leaves")
    if leaves.count() <= max_broadcast:
        leaves = F.broadcast(leaves)
    texts = lines.select("leaf", "id", "line").join(leaves, "leaf").groupBy("id").agg(F.first("line").alias("line"))
    parsed = materialize(texts.join(kinds.select("id", "leaf", "docs", "holder"), "id")
                         .select("leaf", "id", "docs", "holder", _masked(F.split("line", " ")).alias("tokens")), "parsed")
    flat = parsed.select("leaf", "id", "docs", F.posexplode(F.slice("tokens", depth + 1, 1 << 30)).alias("place", "token"))
    constant = flat.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs) \
        .select("leaf", "place", "token", F.lit(True).alias("fixed"))
    fields = flat.join(constant, ["leaf", "place", "token"], "left") \
        .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", F.when(F.col("fixed"), F.col("token")).otherwise("<*>").alias("token")))).alias("rest"))
    rest = F.coalesce(F.transform("rest", lambda x: x["token"]), F.array().cast("array<string>"))
    whole = parsed.join(fields, "id", "left").select("id", "docs", "holder", F.concat(F.slice("tokens", 1, depth), rest).alias("tokens"))
    lead = F.slice("tokens", 1, 2)
    share = F.when((F.size(lead) == 2) & ~F.array_contains(lead, "<*>"), min(min_share, lead_share)).otherwise(min_share)
    whole = whole.withColumns({"n_tokens": F.size("tokens"), "n_constant": F.size(F.filter("tokens", lambda t: t != "<*>"))})
    return whole.filter(F.col("n_constant") * 100 >= F.col("n_tokens") * share) \
        .select("id", F.array_join("tokens", " ").alias("template"), "docs", "holder", "n_tokens", "n_constant")


def recurring(docs: DataFrame, depth: int = 3, min_docs: int = 5, min_share: int = 80, lead_share: int = 70, long_docs: int = 2,
              long_tokens: int = 50, max_broadcast: int = 1_000_000) -> DataFrame:
    """(doc, id): the lines to drop from each document."""
    lines = materialize(lines_of(docs, depth), "lines")
    kinds = materialize(lines.groupBy("id", "leaf", "n_tokens").agg(F.countDistinct("doc").alias("docs"), F.min("doc").alias("holder")), "kinds")
    known = materialize(templates(lines, kinds, depth, min_docs, min_share, lead_share, max_broadcast)
                        .select("id", F.xxhash64("template").alias("template"), "docs", "holder"), "templates")
    # documents of a template: those of its line, or, where it has several, counted once each
    sums = known.groupBy("template").agg(F.sum("docs").alias("most"), F.max("docs").alias("least"), F.min("holder").alias("first")).filter(F.col("most") >= min_docs)
    unsure = known.join(sums.filter(F.col("least") < min_docs), "template").select("id", "template")
    counted = _at(lines.select("doc", "id"), unsure, kinds, max_broadcast).groupBy("template").agg(F.countDistinct("doc").alias("n")) \
        .filter(F.col("n") >= min_docs).select("template", F.lit(True).alias("sure"))
    often = sums.join(counted, "template", "left").filter((F.col("least") >= min_docs) | F.col("sure")).select("template", "first")
    need = F.when(F.col("n_tokens") >= long_tokens, min(min_docs, long_docs)).otherwise(min_docs)
    gone = known.join(often, "template").select("id", F.col("first").alias("holder")) \
        .unionByName(kinds.filter((F.col("docs") >= need) & (F.col("docs") > 1)).select("id", "holder")).groupBy("id").agg(F.min("holder").alias("holder"))
    return _at(lines.select("doc", "id"), gone, kinds, max_broadcast).filter(F.col("doc") > F.col("holder")).select("doc", "id")


def drop_templates(docs: DataFrame, depth: int = 3, min_docs: int = 5, counts: bool = False, **options) -> DataFrame:
    """``docs`` with the recurring lines dropped; with ``counts`` also n_lines and n_dropped."""
    own = uuid.uuid4().hex[:8]
    drop, key = f"drop_{own}", f"doc_{own}"
    base = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    lists = recurring(base.select("doc_id", "text"), depth, min_docs, **options) \
        .groupBy(F.col("doc").alias(key)).agg(F.collect_set("id").alias(drop))
    joined = base.join(lists, F.col("doc_id") == F.col(key), "left")
    lines = F.split("text", "\n")
    left = F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(drop), _id(_tokens(_plain(x))))))
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    columns = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    if counts:
        columns += [F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                    F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(left)).cast("long").alias("n_dropped")]
    return joined.select(*columns)
