"""Exact nearest neighbours by a block matrix join.

Queries and candidates are cut into blocks; every pair of blocks is a tile. A tile multiplies int8 codes (each vector has
a scale of its own, so an outlier widens no error but its own), which gives distances with an error of at most the sum of
both quantisation errors. Pairs whose lower bound is above the k-th best known upper bound of their query are dropped; the
others are measured again in double precision on the original vectors, in slices of bounded size. Each
partition keeps the k best of its tiles in heaps, and the heaps of a query are merged.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows without id, take no
part; a row is no neighbour of a query with its id; a query id that has several vectors searches with the smallest;
candidates that share an id are all returned; vectors of different lengths never meet; ties go to the smaller id; fewer
candidates than k are all returned; an empty table gives an empty table. Other input columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
# Candidates that a tile compares at a time, and pairs that it measures again at a time.
SLICE = 1024
PAIRS = 1 << 16
RESULT = "query_id bigint, vec_id bigint, score double"


def usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v, size) of the vectors that take part."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    return rows.filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
        & F.exists("v", lambda x: x != 0)).withColumn("size", F.size("v"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of the rows of a and b, summed in order of the components."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        total += d * d
    return np.sqrt(total)


def _codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the step of each vector's scale, its squared length as coded and its quantisation error."""
    step = np.abs(v).max(axis=1, initial=0) / 127
    step[step == 0] = 1.0
    codes = np.rint(v / step[:, None]).astype(np.int8)
    near = codes * step[:, None]
    return codes, step, (near ** 2).sum(axis=1), np.sqrt(((v - near) ** 2).sum(axis=1))


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
         k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query in one tile: (query id, id, distance). Candidates pass in slices."""
    codes, step, square, error = _codes(queries)
    # Sums of products of codes are whole numbers below 2**24 (2**53), so float arithmetic gives them exactly.
    kind = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64
    best_score, best_id = np.full((len(queries), k), np.inf), np.zeros((len(queries), k), np.int64)
    for a in range(0, len(ids), SLICE):
        own_codes, own_step, own_square, own_error = _codes(vectors[a:a + SLICE])
        total = square[:, None] + own_square
        near = (codes.astype(kind) @ own_codes.astype(kind).T).astype(float) * (2 * step[:, None] * own_step)
        near = np.sqrt(np.maximum(total - near, 0))
        # Both quantisation errors, and what rounding may do to a difference of large squares.
        slack = error[:, None] + own_error + 1e-7 * np.sqrt(total)
        own = query_ids[:, None] == ids[a:a + SLICE]
        upper = np.concatenate([best_score, np.where(own, np.inf, near + slack)], axis=1)
        bound = np.partition(upper, k - 1, axis=1)[:, k - 1]
        q, c = np.nonzero((near - slack <= bound[:, None]) & ~own)
        for at in range(0, len(q), PAIRS):
            best_score, best_id = _closer(best_score, best_id, q[at:at + PAIRS], ids[a + c[at:at + PAIRS]], distances(
                queries[q[at:at + PAIRS]], vectors[a + c[at:at + PAIRS]]))
    found = np.isfinite(best_score)
    return query_ids[np.nonzero(found)[0]], best_id[found], best_score[found]


def _closer(best_score: np.ndarray, best_id: np.ndarray, q: np.ndarray, ids: np.ndarray,
            scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each query, old and new ones together."""
    k, old = best_score.shape[1], np.isfinite(best_score)
    line = np.concatenate([np.nonzero(old)[0], q])
    score, every = np.concatenate([best_score[old], scores]), np.concatenate([best_id[old], ids])
    order = np.lexsort((every, score, line))
    line, score, every = line[order], score[order], every[order]
    rank = np.arange(len(line)) - np.searchsorted(line, line)
    line, score, every, rank = (x[rank < k] for x in (line, score, every, rank))
    best_score, best_id = np.full_like(best_score, np.inf), np.zeros_like(best_id)
    best_score[line, rank], best_id[line, rank] = score, every
    return best_score, best_id


def _merge(found: Iterator[tuple[int, int, float]], k: int) -> dict[int, list[tuple[float, int]]]:
    """The k smallest (score, id) of each query, in heaps of k."""
    heaps: dict[int, list[tuple[float, int]]] = defaultdict(list)
    for query, vec, score in found:
        heap, item = heaps[query], (-score, -vec)
        if len(heap) < k:
            heapq.heappush(heap, item)
        elif item > heap[0]:
            heapq.heapreplace(heap, item)
    return heaps


def nearest(df: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id",
            vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows that ``is_query`` (over the id column) picks."""
    queries = usable(df.filter(is_query), id_column, vector_column).groupBy("id", "size").agg(F.min("v").alias("v"))
    rows = usable(df, id_column, vector_column)
    n_queries = queries.count()
    query_blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    blocks = max(1, math.ceil(rows.count() / CANDIDATE_BLOCK))
    left = queries.select("size", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("qb"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("cb"), "id", "v")
    right = rows.select("size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("qb"),
                        # Repeated rows are dealt out too.
                        F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).alias("cb"), "id", "v")

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        table = table.combine_chunks()
        flat = pa.concat_arrays([chunk.flatten() for chunk in table.column("v").chunks])
        return table.column("id").to_numpy(), flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        query, vec, score = tile(*matrix(a), *matrix(b), k)
        return pa.table({"query_id": query, "vec_id": vec, "score": score})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((q, v, s) for batch in batches for q, v, s in zip(
            *(batch.column(x).to_pylist() for x in ("query_id", "vec_id", "score"))))
        heaps = _merge(found, k)
        flat = [(q, -v, -s) for q, heap in heaps.items() for s, v in heap]
        for a in range(0, len(flat), 10_000):
            q, v, s = zip(*flat[a:a + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()),
                                              pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((q, v, s) for batch in batches for q, v, s in zip(
            *(batch.column(x).to_pylist() for x in ("query_id", "vec_id", "score"))))
        flat = [(q, r, -v, -s) for q, heap in _merge(found, k).items()
                for r, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        for a in range(0, len(flat), 10_000):
            q, r, v, s = zip(*flat[a:a + 10_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(r, pa.int32()), pa.array(v, pa.int64()), pa.array(s, pa.float64())],
                names=["query_id", "rank", "vec_id", "score"])

    keys = ["size", "qb", "cb"]
    tiles = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, RESULT)
    # At most k rows for each query and partition are sent on.
    return tiles.mapInArrow(best, RESULT).repartition("query_id").mapInArrow(
        last, "query_id bigint, rank int, vec_id bigint, score double")
