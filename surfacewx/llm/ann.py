"""Nearest neighbours by inner product: a block matrix join with int8 tiles.

Queries come in chunks of a bounded size, each broadcast; candidates are read
where they lie, in blocks of ``BLOCK`` rows, so no vector is shuffled. Vectors
are quantised to int8 with a scale of their own. One matrix product gives a
tile of approximate products, and with ``q = q' + dq`` and ``x = x' + dx``
(the primes quantised) the error is at most ``|dq| |x| + |q'| |dx|``. In every
tile a query's candidates whose upper bound lies below its k-th best lower
bound, or below the k-th best product it has already, are out; the survivors'
products are recomputed in double precision from the original vectors and
merged into the query's heap. So the result is exact. Each task gives at most
``k`` rows per query, which are merged by rank at the end.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surfacewx.llm.common import mapped, written

QUERY_CHUNK = 8192
BLOCK = 2048


def usable(vec: Column) -> Column:
    """Whether a vector takes part: not null, not empty, all components finite, one at least not zero."""
    big = F.lit(float("inf"))
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < big))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


class Block:
    """Vectors of one length with their int8 codes and error norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        scale = np.abs(self.vectors).max(axis=1, keepdims=True) / 127.0
        scale[scale == 0] = np.finfo(float).tiny  # below the smallest normal number
        self.codes = np.clip(np.rint(self.vectors / scale), -127, 127).astype(np.int8)
        self.scale = scale[:, 0]
        near = self.codes * scale
        self.norm, self.near_norm = (np.sqrt((v * v).sum(axis=1)) for v in (self.vectors, near))
        self.error = np.sqrt(((self.vectors - near) ** 2).sum(axis=1))


def tile(q: Block, x: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of all ``q`` with all ``x``.

    Sums of int8 products are whole numbers below 2^24 for up to 1040
    components, so single precision holds them exactly; beyond, double does."""
    kind = np.float32 if q.codes.shape[1] <= 1040 else np.float64
    near = (q.codes.astype(kind) @ x.codes.astype(kind).T).astype(np.float64)
    near *= q.scale[:, None]
    near *= x.scale[None, :]
    off = q.error[:, None] * x.norm[None, :] + q.near_norm[:, None] * x.error[None, :]
    off += 1e-9 * q.norm[:, None] * x.norm[None, :] + np.finfo(float).tiny  # rounding of the lines above
    low, high = near - off, near + off
    # Where products overflow there is no bound.
    return np.nan_to_num(low, copy=False, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(high, copy=False, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in order of the components."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def search_block(q: Block, x: Block, heaps: list[list[tuple[float, int]]], held: list[dict[int, float]], k: int) -> None:
    """Merge the candidates of ``x`` into the heaps of ``q``: entries are
    ``(score, -id)``, so that of equal scores the larger id goes first."""
    low, high = tile(q, x)
    own = q.ids[:, None] == x.ids[None, :]
    low[own], high[own] = -np.inf, -np.inf
    best = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    if len(x.ids) > k:
        # The same id can stand in x several times and counts once: then no bound from this tile.
        if len(np.unique(x.ids)) == len(x.ids):
            best = np.maximum(best, np.partition(low, -k, axis=1)[:, -k])
    rows, cols = np.nonzero((high >= best[:, None]) & ~own)
    for s in range(0, len(rows), 1 << 18):
        r, c = rows[s : s + (1 << 18)], cols[s : s + (1 << 18)]
        scores = products(q.vectors[r], x.vectors[c])
        for i, score, at in zip(r.tolist(), scores.tolist(), x.ids[c].tolist(), strict=True):
            heap, known = heaps[i], held[i]
            if at in known:
                if score <= known[at]:
                    continue
                heap.remove((known[at], -at))
                heapq.heapify(heap)
                del known[at]
            if len(heap) < k:
                heapq.heappush(heap, (score, -at))
                known[at] = score
            elif (score, -at) > heap[0]:
                del known[-heapq.heappushpop(heap, (score, -at))[1]]
                known[at] = score


def _blocks(ids: np.ndarray, column: pa.Array) -> Iterator[Block]:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        for s in range(0, len(rows), BLOCK):
            some = rows[s : s + BLOCK]
            yield Block(ids[some], flat[starts[some][:, None] + np.arange(d)])


def chunk_of(chunks: int) -> Column:
    """The chunk of a query row ``(id, v)``."""
    return F.pmod(F.xxhash64("id", "v"), F.lit(chunks))


def search(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_chunk: int = QUERY_CHUNK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible
    by ``every`` the ``k`` rows with the largest inner products, its own id
    left out; equal scores rank by smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components
    and rows with a null id take no part; vectors of another length than the
    query's are no candidates. An id that stands in several rows counts once
    per query, with the largest product of its rows. Other columns are not read.
    """
    spark = df.sparkSession
    vectors = df.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    # Equal rows ask the same, so each stands once; rows of one id with different vectors
    # are dealt apart by a hash of both, so that a chunk's bound holds whatever the ids are.
    queries = written(vectors.filter(F.col("id") % every == 0).distinct(), "queries")
    n = queries.count()
    chunks = max(1, -(-n // query_chunk))
    found = None
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    for chunk in range(chunks):
        rows = queries.filter(chunk_of(chunks) == chunk).toArrow()
        column = rows.column("v").combine_chunks()
        sent = spark.sparkContext.broadcast([(b.ids, b.vectors) for b in _blocks(rows.column("id").to_numpy(), column)])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q = [Block(*b) for b in sent.value]
            heaps = [[[] for _ in b.ids] for b in q]
            held = [[{} for _ in b.ids] for b in q]
            for batch in batches:
                for x in _blocks(batch.column(0).to_numpy(), batch.column(1)):
                    for b, h, m in zip(q, heaps, held, strict=True):
                        if b.vectors.shape[1] == x.vectors.shape[1]:
                            search_block(b, x, h, m, k)
            for b, h in zip(q, heaps, strict=True):
                out = [(i, -at, score) for i, heap in zip(b.ids.tolist(), h, strict=True) for score, at in heap]
                for s in range(0, len(out), 1 << 16):
                    yield pa.RecordBatch.from_pylist([{"query_id": i, "vec_id": at, "score": x} for i, at, x in out[s : s + (1 << 16)]], schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

        part = mapped(vectors, run, schema)
        found = part if found is None else found.unionByName(part)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
