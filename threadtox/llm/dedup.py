"""MinHash near-duplicate groups by a signature-coordinate inverted join.

Every document gets a signature of ``coords`` minima, one for each hash function. It is posted under each
(coordinate, value) pair; documents that agree on at least ``match`` coordinates are candidates, and a
candidate pair is a link if the full shingle sets have ``100 * |A & B| >= percent * |A | B|``.

How the join is kept small:

* Documents with equal shingle sets are one class, posted once. A class is linked through its text.
* Prefix: two signatures that agree on ``match`` of ``coords`` coordinates share one of the
  ``coords - match + 1`` rarest pairs of either, in one order of all pairs (posting-list length, pair). Only
  these postings are joined; the long lists are skipped, and the full count is taken from the two signatures
  of a candidate pair (the skipped lists are probed, not merged).
* Centres: each list first links its members with its most central member only (the one whose pairs are
  posted most), which costs one pair per posting. The exact overlap with the centre then bounds every pair
  (A, B) of the list: if A and B share no shingle outside the centre p, their overlap is at most
  min(|A & p|, |B & p|). So what is left of a list are pairs whose sizes and overlaps allow a link by that
  bound (joined by size, not by list), and pairs that share a shingle outside the centre, which are posted
  once more under these shingles only.
* Groups: a pair inside one component cannot change any group, so it is not looked at again.

No link between different groups is lost by this, and a group of n near copies costs about n pairs, not
n * n / 2.

With the defaults a pair at the threshold (similarity 0.85) agrees on fewer than 28 of 48 coordinates with a
probability of 2e-6, a pair at 0.9 with 2e-9.

Defined results: a null or empty text, or one without words, has no shingles and is a group of its own.
Very long texts are read whole.
Rows are documents: repeated rows are exact copies of each other and share a group. A row with a null
``doc_id`` links with nothing and is kept, with a null ``component_id``. An empty table gives an empty
result. Other input columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadtox.llm import textarrays as ta
from threadtox.llm.rows import arrow_map, materialize, typed

SHINGLE = 5


def _coefficients(coords: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    return (rng.integers(0, 2**63, coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2**63, coords, dtype=np.uint64))


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text's begin."""
    h, first = ta.shingles(ta.words_of(texts), size)
    sets = [np.unique(h[first[i]:first[i + 1]]) for i in range(len(texts))]
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=at[1:])
    return (np.concatenate(sets) if sets else h), at


def few_files(df: DataFrame, tag: str) -> DataFrame:
    """``materialize`` for tables of links and lists: two files a core at most, however many shuffle partitions."""
    return materialize(df.coalesce(max(8, 2 * df.sparkSession.sparkContext.defaultParallelism)), tag)


def signatures(docs: DataFrame, coords: int = 48, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, set_id, sig) for each row; set_id and sig are null without shingles."""
    a, b = _coefficients(coords)

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0)
        for rows, texts in ta.sliced(batch, "text"):
            h, at = shingle_sets(texts, size)
            n = np.diff(at)
            some = np.flatnonzero(n)
            sig = np.zeros((len(texts), coords), dtype=np.uint32)
            if len(some):
                for j in range(coords):
                    sig[some, j] = np.minimum.reduceat(h * a[j] + b[j], at[some]) >> np.uint64(32)
            none = pa.array(n == 0)
            yield pa.RecordBatch.from_arrays([
                ids.slice(rows.start, rows.stop - rows.start), pa.array(n),
                pa.array([xxhash.xxh3_128_digest(h[at[i]:at[i + 1]].tobytes()) if n[i] else None for i in range(len(texts))],
                         type=pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * coords),
                                         pa.array(sig.reshape(-1).view(np.int32)), mask=none),
            ], names=["doc_id", "n_shingles", "set_id", "sig"])

    return arrow_map(typed(docs, doc_id="long", text="string"), of,
                     "doc_id long, n_shingles long, set_id binary, sig array<int>")


def _pair_key(coord: str = "coord", value: str = "value"):
    return F.shiftleft(F.col(coord).cast("long"), 32) + (F.col(value).cast("long") + F.lit(1 << 31))


def postings(classes: DataFrame, coords: int, match: int) -> DataFrame:
    """Prefix postings (pair, node, n, weight): each class under its rarest pairs, rarest first.

    Pairs posted once come first in the order and lead nowhere, so they are counted, not kept.
    """
    flat = classes.select("node", "n", F.posexplode("sig").alias("coord", "value")) \
        .select("node", "n", _pair_key().alias("pair"))
    lengths = flat.groupBy("pair").agg(F.count("*").alias("posted")).filter("posted > 1")
    lists = flat.join(lengths, "pair") \
        .groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("posted", "pair"))).alias("own"))
    return lists.filter(F.size("own") >= match) \
        .select("node", "n", F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["posted"]).alias("weight"),
                F.explode(F.slice("own", F.lit(1), F.size("own") - (match - 1))).alias("x")) \
        .select(F.col("x.pair").alias("pair"), "node", "n", "weight")


def _near_in_size(a, b, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, match: int, percent: int, size: int) -> DataFrame:
    """Of the pairs (a, b) those that agree on ``match`` coordinates (0: all), with what their full sets have in common.

    Returns a, b, n_a, n_b, both (overlap), linked, outside (the shingles of a that b has not).
    """
    def side(x: str) -> DataFrame:
        return classes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"),
                              F.col("doc_id").alias(f"id_{x}"), F.col("set_id").alias(f"set_{x}"))

    texts = typed(docs, doc_id="long", text="string").filter("doc_id IS NOT NULL")
    found = pairs.join(side("a"), "a").join(side("b"), "b")
    if match:
        found = found.filter(_agreements("sig_a", "sig_b") >= match)
    found = found.drop("sig_a", "sig_b")
    for x in "ab":
        found = found.join(texts.select(F.col("doc_id").alias(f"id_{x}"), F.col("text").alias(f"text_{x}")), f"id_{x}")

    def compare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b, set_a, set_b = (batch.column(i).to_pylist() for i in range(4))
        recent: OrderedDict[bytes, np.ndarray | None] = OrderedDict()  # a list's centre comes row after row

        def hashes(set_id: bytes, text: bytes) -> np.ndarray | None:
            if set_id not in recent:
                h, _ = shingle_sets([text], size)
                # another row of the same doc_id has another text: not this class
                recent[set_id] = h if xxhash.xxh3_128_digest(h.tobytes()) == set_id else None
                if len(recent) > 64:
                    recent.popitem(last=False)
            recent.move_to_end(set_id)
            return recent[set_id]

        out = []
        for i in range(batch.num_rows):
            p = hashes(set_a[i], batch.column(4)[i].as_buffer().to_pybytes())
            q = hashes(set_b[i], batch.column(5)[i].as_buffer().to_pybytes())
            if p is None or q is None:
                continue
            at = np.minimum(np.searchsorted(q, p), len(q) - 1)
            shared = q[at] == p
            both = int(shared.sum())
            out.append((a[i], b[i], len(p), len(q), both, 100 * both >= percent * (len(p) + len(q) - both),
                        p[~shared].view(np.int64)))
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([
                *(pa.array(c, type=pa.int64()) for c in cols[:5]), pa.array(cols[5], type=pa.bool_()),
                pa.array(cols[6], type=pa.list_(pa.int64()))], names=["a", "b", "n_a", "n_b", "both", "linked", "outside"])

    return arrow_map(found.select("a", "b", "set_a", "set_b", "text_a", "text_b"), compare,
                     "a long, b long, n_a long, n_b long, both long, linked boolean, outside array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternates large-star and small-star steps (each links neighbours to a node's smallest one) until every
    component is a star; every step is a written table, so no lineage grows.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    while True:
        links = few_files(links, "links")
        roles = links.select(F.col("u").alias("node"), F.lit(1).alias("under"), F.lit(0).alias("over")) \
            .unionAll(links.select(F.col("v").alias("node"), F.lit(0).alias("under"), F.lit(1).alias("over")))
        if roles.groupBy("node").agg(F.sum("under").alias("under"), F.sum("over").alias("over")) \
                .filter("under > 1 OR (under > 0 AND over > 0)").isEmpty():
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")) \
                .unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        links = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v")) \
            .filter("u <> v").distinct()


def centres(lists: DataFrame) -> DataFrame:
    """(pair, c): the most central member of each list."""
    return lists.groupBy("pair").agg(F.max_by(F.struct("node", "n", "root"), F.struct("weight", -F.col("node"))).alias("c"))


def with_roots(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists with members in more than one component, each posting with its root."""
    rooted = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_lists = rooted.groupBy("pair").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("pair")
    return rooted.join(open_lists, "pair")


def _centre_pairs(lists: DataFrame, centre: DataFrame) -> DataFrame:
    return lists.join(centre, "pair").filter("root <> c.root").select(F.col("node").alias("a"), F.col("c.node").alias("b")).distinct()


def _agreements(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)


def links(classes: DataFrame, docs: DataFrame, percent: int, coords: int, match: int, size: int) -> DataFrame | None:
    """Links (a, b) between classes, enough of them to connect every group; None if there is none to look for."""
    def confirmed(pairs: DataFrame, least: int) -> DataFrame:
        return materialize(confirm(pairs, classes, docs, least, percent, size), "compared")

    def only_links(compared: DataFrame) -> DataFrame:
        return compared.filter("linked").select("a", "b")

    lists = materialize(postings(classes, coords, match), "postings")
    if lists.isEmpty():
        return None
    centre = few_files(centres(lists.withColumn("root", F.col("node"))), "centres")
    first = confirmed(_centre_pairs(lists.withColumn("root", F.col("node")), centre), 0)
    edges = only_links(first)
    roots = components(edges)

    # what the comparison with centre p says of each member of its lists; p itself is wholly inside p
    measured = first.select(F.col("a").alias("node"), F.col("b").alias("p"), F.col("n_a").alias("n"), "both", "linked") \
        .unionAll(centre.select("c.node", "c.n").distinct().select("node", F.col("node").alias("p"), "n", F.col("n").alias("both"), F.lit(True).alias("linked")))
    measured = few_files(measured.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
                         .join(classes.select("node", "sig"), "node"), "measured")

    # pairs that share nothing outside p: (100 + percent) * min(both) >= percent * (n + n), by size
    x = measured.filter("NOT linked") \
        .withColumn("least_m", F.expr(f"(n * {percent} + 99) div 100")) \
        .withColumn("most_m", F.expr(f"{100 + percent} * both div {percent} - n")).filter("least_m <= most_m") \
        .withColumn("m", F.explode(F.sequence("least_m", "most_m"))).alias("x")
    y = measured.alias("y")
    allowed = x.join(y, F.expr(f"x.p = y.p AND x.m = y.n AND x.root <> y.root AND {100 + percent} * least(x.both, y.both) >= {percent} * (x.n + y.n)")
                     & (_agreements("x.sig", "y.sig") >= match)) \
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    # pairs that share shingles outside p: their rarest, with what can still follow the first shared one
    lists = few_files(with_roots(outside_postings(first, percent), roots), "lists")
    x, y = lists.alias("x"), lists.alias("y")
    follow = F.expr("x.pair = y.pair AND x.node < y.node AND x.root <> y.root"
                    f" AND {percent} * (x.n + y.n) <= {100 + percent} * (least(x.both, y.both) + 1 + least(x.after, y.after))")
    first_shared = ~F.arrays_overlap("x.before", "y.before")
    beyond = x.join(y, follow & _near_in_size(F.col("x.n"), F.col("y.n"), percent) & first_shared).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    second = confirmed(allowed.unionAll(beyond).distinct(), match)
    return edges.unionAll(only_links(second))


def outside_postings(compared: DataFrame, percent: int) -> DataFrame:
    """Postings (pair, node, n, both, after, before) of each node's shingles outside a centre, rarest first.

    A link needs ``need`` shared shingles outside the centre beside those inside it, so the rarest
    ``outside - need + 1`` shingles suffice; ``after`` counts those that follow in the same order. ``before`` has up to
    16 that precede: two nodes that share one of these meet there already.
    """
    u = compared.select(F.col("a").alias("node"), F.col("b").alias("p"), F.col("n_a").alias("n"), "both", "outside") \
        .withColumn("u", F.size("outside").cast("long"))
    flat = u.select("node", "p", "n", "both", "u", F.explode("outside").alias("s")).withColumn("pair", F.xxhash64("p", "s")).drop("s")
    lengths = flat.groupBy("pair").agg(F.count("*").alias("posted")).filter("posted > 1")
    own = flat.join(lengths, "pair").groupBy("node", "p", "n", "both", "u") \
        .agg(F.array_sort(F.collect_list(F.struct("posted", "pair"))).alias("own")) \
        .withColumn("alone", F.col("u") - F.size("own")) \
        .withColumn("need", F.expr(f"greatest(1, ({percent} * (n + ({percent} * n + 99) div 100) + {99 + percent}) div {100 + percent} - both)"))
    return own.withColumn("take", F.expr("cast(greatest(0, least(u - need + 1 - alone, size(own))) as int)")) \
        .select("node", "n", "both", "u", "alone", "own", F.posexplode(F.expr("slice(own, 1, take)")).alias("i", "x")) \
        .select(F.col("x.pair").alias("pair"), "node", "n", "both", F.expr("u - alone - i - 1").alias("after"),
                F.expr("transform(slice(own, greatest(1, i - 15), least(i, 16)), x -> x.pair)").alias("before"))


def near_duplicates(docs: DataFrame, percent: int = 85, coords: int = 48, match: int = 28, size: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id of its group), kept."""
    signed = materialize(signatures(docs, coords, size), "signatures")
    sets = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(
        sets.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    edges = links(classes, docs, percent, coords, match, size)
    ids = classes.select("set_id", "node", "doc_id")
    if edges is None:
        ids = ids.select("set_id", F.col("doc_id").alias("component_id"))
    else:
        rooted = few_files(ids.join(components(edges), "node", "left"), "rooted")
        smallest = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least_id"))
        ids = rooted.join(smallest, "root", "left").select("set_id", F.coalesce("least_id", "doc_id").alias("component_id"))
    alone = F.col("set_id").isNull() | F.col("doc_id").isNull()
    linked = signed.filter(~alone).select("doc_id", "n_shingles", "set_id").join(ids, "set_id") \
        .select("doc_id", "n_shingles", "component_id")
    rest = signed.filter(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionAll(rest).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near duplicates: of each group the rows of its smallest doc_id stay, equal rows of it once.

    If a doc_id has several texts, all of them stay with the one that stands for its group. Rows with a null doc_id
    stay.
    """
    own = uuid.uuid4().hex[:8]
    kept = near_duplicates(docs, **options).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(f"id_{own}")).distinct()
    first = docs.filter("doc_id IS NOT NULL").join(kept, F.col("doc_id").cast("long") == F.col(f"id_{own}"), "left_semi") \
        .withColumn(f"text_{own}", F.xxhash64("text")).dropDuplicates(["doc_id", f"text_{own}"]).drop(f"text_{own}")
    return first.unionAll(docs.filter("doc_id IS NULL"))
