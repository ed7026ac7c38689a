"""Exact top-k inner products with an impact-ordered index, score at a time.

Components become integers (``floor(scale * x)``): the quantised impacts. Rows are dealt into blocks of about
``block_rows`` by the hash of their id. A block's index has one posting segment for each (dimension, impact): the places
of the rows with that impact there, segments in order of descending absolute impact; impacts of 0 have none. The index is
written once, one row a block.

Queries go to the tasks in chunks of at most ``chunk_mb``, each a broadcast; a task walks its blocks with a batch of
queries at a time. Segments are added to the batch's accumulators in impact order. What the segments not yet added can
still change in a row's score is at most (norm of the row's smaller components) x (norm of the query), so a query's
k-th best lower bound, or the k-th best of the blocks before, proves all other rows out. Adding stops when that leaves at
most ``stop_share`` of the rows; where no proof is found all segments are added. The rows left are scored exactly from
the stored vectors. Each task returns k rows a query; these are ranked once more over all tasks.

Work grows with queries x rows, as asked for (a query set against all rows); memory does not: a task holds a block, a
chunk of queries with their k best, and one batch's accumulators.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null id, take no part. Rows
that share an id are one row; the smallest of their vectors stands for it. Vectors of different lengths are compared on
the dimensions both have; an empty vector scores 0 with all. Scaled components beyond +-2^24 count as that bound, so that
scores fit 64 bits. Ties go to the smaller id, at the k-th place too. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadtox.llm.rows import materialize, typed
from threadtox.session import ship_package

BOUND = float(1 << 24)
_INDEX = "ids binary, width int, vectors binary, dims binary, impacts binary, ends binary, places binary"
_FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, impacts array<int>): one row for each id with a usable vector."""
    def impact(x):
        return F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(-BOUND)), F.lit(BOUND))).cast("int")

    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return typed(vectors, vec_id="long", embedding="array<double>").filter(F.col("vec_id").isNotNull() & usable) \
        .groupBy("vec_id").agg(F.min(F.transform("embedding", impact)).alias("impacts"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of integers as a matrix, shorter ones filled with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def segments(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dimension, impact, end) of each posting segment by descending absolute impact, and the rows they hold."""
    row, dim = np.nonzero(vectors)
    impact = vectors[row, dim]
    order = np.lexsort((row, dim, impact, -np.abs(impact)))
    row, dim, impact = row[order], dim[order], impact[order]
    last = np.flatnonzero(np.append((dim[1:] != dim[:-1]) | (impact[1:] != impact[:-1]), True)) if len(row) else row
    return dim[last], impact[last], last + 1, row


def build_index(rows: DataFrame, block_rows: int) -> DataFrame:
    """One row for each block of the rows (vec_id, impacts)."""
    n = max(1, -(-rows.count() // block_rows))

    def of(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        vectors = _matrix(table.column("impacts"))[order]
        dims, impacts, ends, places = segments(vectors)
        parts = [ids[order].astype(np.int64), vectors.astype(np.int32), dims.astype(np.int32), impacts.astype(np.int32), ends.astype(np.int64), places.astype(np.int32)]
        cells = [pa.array([p.tobytes()], pa.binary()) for p in parts]
        return pa.Table.from_arrays([cells[0], pa.array([vectors.shape[1]], pa.int32()), *cells[1:]],
                                    names=["ids", "width", "vectors", "dims", "impacts", "ends", "places"])

    ship_package(rows.sparkSession)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).repartition(n, "block")
    return materialize(dealt.groupBy("block").applyInArrow(of, _INDEX), "impact-index")


class Block:
    """A block's index as arrays."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.vectors = np.frombuffer(row["vectors"], dtype=np.int32).reshape(len(self.ids), row["width"])
        self.dims, self.impacts = np.frombuffer(row["dims"], dtype=np.int32), np.frombuffer(row["impacts"], dtype=np.int32)
        self.ends, self.places = np.frombuffer(row["ends"], dtype=np.int64), np.frombuffer(row["places"], dtype=np.int32)

    def stops(self, shares: tuple[float, ...]) -> list[int]:
        """Segment counts to try a proof at: after given shares of the postings, at ends of an impact; the last is the end."""
        level = np.abs(self.impacts)
        whole = np.flatnonzero(np.append(level[1:] != level[:-1], True)) + 1 if len(level) else np.zeros(1, dtype=np.int64)
        at = [int(np.searchsorted(self.ends, s * len(self.places))) + 1 for s in shares]
        return sorted({int(whole[min(np.searchsorted(whole, x), len(whole) - 1)]) for x in at} | {len(level)})


def score(block: Block, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int, stop_share: float,
          shares: tuple[float, ...] = (0.6, 0.75, 0.88)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, id, score) of all rows of ``block`` that may be among a query's k best.

    ``floor`` is a score that k other rows of each query are known to reach.
    """
    width = min(queries.shape[1], block.vectors.shape[1])
    q = queries[:, :width]
    vectors = block.vectors[:, :width].astype(np.int64)
    n = len(block.ids)
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    most = float(np.abs(q).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(width, 1)
    kind = np.int32 if most < 2**31 else np.int64
    by_dim = np.ascontiguousarray(q.T.astype(kind))
    acc = np.zeros((n, len(q)), dtype=kind)
    own = block.ids[:, None] == query_ids[None, :] if len(np.intersect1d(block.ids, query_ids)) else None
    at = 0
    for stop in block.stops(shares):
        for s in range(at, stop):
            d = block.dims[s]
            if d < width:
                acc[block.places[block.ends[s - 1] if s else 0:block.ends[s]]] += by_dim[d] * kind(block.impacts[s])
        at, final = stop, stop == len(block.dims)
        small = np.abs(vectors) <= (abs(int(block.impacts[stop])) if not final else -1)
        slack = np.ceil(np.sqrt((np.where(small, vectors, 0).astype(np.float64) ** 2).sum(1))[:, None] * norm[None, :] + 1) if not final else np.zeros((n, 1))
        if n > k + 1:  # own row aside, k rows reach this
            low = np.partition(acc - slack, n - k - 1, axis=0)[n - k - 1]
            floor = np.maximum(floor, low)
        possible = acc + slack >= floor[None, :]
        if final or possible.mean() <= stop_share:
            break
    if own is not None:
        possible &= ~own
    row, query = np.nonzero(possible)
    exact = np.empty(len(row), dtype=np.int64)
    for i in range(0, len(row), 1 << 16):
        part = slice(i, i + (1 << 16))
        exact[part] = np.einsum("ij,ij->i", vectors[row[part]], q[query[part]])
    return query, block.ids[row], exact


class Best:
    """The k best rows of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.n = np.zeros(n, dtype=np.int64)

    def floor(self, part: slice) -> np.ndarray:
        full = self.n[part] == self.k
        return np.where(full, self.score[part, -1].astype(np.float64), -np.inf)

    def add(self, part: slice, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        old = np.arange(self.k) < self.n[part, None]
        q = np.concatenate([np.nonzero(old)[0], query])
        s, i = np.concatenate([self.score[part][old], score]), np.concatenate([self.ids[part][old], ids])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        q, s, i, place = q[keep], s[keep], i[keep], place[keep]
        self.score[part][q, place], self.ids[part][q, place] = s, i
        self.n[part] = np.bincount(q, minlength=len(old))


def _walk(index: DataFrame, shared, k: int, batch: int, stop_share: float) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        queries = queries.astype(np.int64)
        best = Best(len(ids), k)
        for b in batches:
            for i in range(b.num_rows):
                block = Block(b.slice(i, 1).to_pylist()[0])
                for at in range(0, len(ids), batch):
                    part = slice(at, at + batch)
                    best.add(part, *score(block, queries[part], ids[part], best.floor(part), k, stop_share))
        have = np.arange(k) < best.n[:, None]
        query = ids[np.nonzero(have)[0]]
        for i in range(0, len(query), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(query[part]), pa.array(best.ids[have][part]), pa.array(best.score[have][part])],
                                             names=["query_id", "vec_id", "score"])

    return index.mapInArrow(of, _FOUND)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, scale: int = 64, block_rows: int = 4096, batch: int = 512,
          chunk_mb: int = 16, stop_share: float = 0.05) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of another id with the highest score for each row of ``queries``.

    Both tables have (vec_id, embedding). ``block_rows`` and ``batch`` bound a task's accumulators, ``chunk_mb`` a broadcast.
    """
    spark = rows.sparkSession
    index = build_index(materialize(quantised(rows, scale), "impacts"), block_rows)
    asked = materialize(quantised(queries, scale), "queries")
    width, n = asked.agg(F.max(F.size("impacts")), F.count("*")).first()
    chunks = max(1, -(-(n * ((width or 0) * 4 + 8 + 16 * k)) // (chunk_mb << 20)))  # vector, id, k best
    parts = []
    for c in range(chunks):
        own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).orderBy("vec_id").toArrow()  # a chunk's bytes at most
        shared = spark.sparkContext.broadcast((own.column("vec_id").to_numpy(), _matrix(own.column("impacts")).astype(np.int32)))
        found = _walk(index, shared, k, batch, stop_share)
        if chunks > 1:
            found = materialize(found, "found")
            shared.unpersist()
        parts.append(found)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
