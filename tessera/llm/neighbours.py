"""Nearest neighbours of vectors (operator 6).

Method: block matrix join. Vectors are rounded to int8 with a scale and the norm of what rounding left over. A tile of
queries meets a tile of candidates in integer matrix products (exact in float32, from 1,041 parts on in float64), which with those norms bounds every
distance from both sides; pairs whose lower bound is above the k-th upper bound are out, the others are computed again in
double precision and kept in a heap per query. The heaps of all tiles are merged by query. The result is exact.

A group is one tile of candidates (about TILE rows) and one block of queries (about QUERY_BLOCK), whatever the table's size;
within it CELLS pairs are multiplied at a time.

Edge cases: vectors that are null, all zero, or hold null or non-finite parts take no part, nor do rows without id; rows of
one id count once (the smallest vector); an empty table gives an empty table; vectors of different lengths don't meet; with fewer than k candidates all are
returned; equal distances go by smaller vec_id; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidates of a tile and queries of a block, about, and pairs of them that are multiplied at a time.
TILE, QUERY_BLOCK, CELLS = 16384, 8192, 1 << 21


def usable(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """One row per id: `id` and `v`, the vectors that take part."""
    v = F.col(vector)
    fit = F.expr(f"forall({vector}, x -> x is not null and x = x and abs(x) < double('infinity')) and exists({vector}, x -> x <> 0)")
    rows = df.where(F.col(ident).isNotNull() & v.isNotNull()).where(fit)
    return rows.groupBy(F.col(ident).cast("long").alias("id")).agg(F.min(v).alias("v"))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 parts, scales, and norms of the rounding errors (a little enlarged)."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - q * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9)
    return q, scale, error


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed from the first part to the last in double precision."""
    d = a - b
    return np.sqrt(np.add.accumulate(d * d, axis=1)[:, -1])


def tile_heaps(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query its k nearest of the tile's candidates, as (distance, id) in order."""
    qq, qs, qe = quantised(queries)
    cq, cs, ce = quantised(vectors)
    q_norm, c_norm = np.sqrt((queries**2).sum(1)), np.sqrt((vectors**2).sum(1))
    wide = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products stay exact
    product = (qq.astype(wide) @ cq.astype(wide).T).astype(np.float64) * qs[:, None] * cs
    slack = qe[:, None] * (c_norm + ce) + (q_norm + qe)[:, None] * ce
    middle = q_norm[:, None] ** 2 + c_norm**2 - 2 * product
    slack = 2 * slack + 1e-9 * (q_norm[:, None] ** 2 + c_norm**2)
    low, high = middle - slack, middle + slack
    own = query_ids[:, None] == ids
    high[own] = np.inf
    edge = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] > k else np.full(len(queries), np.inf)
    left = (low <= edge[:, None]) & ~own
    for i in range(len(queries)):
        at = np.flatnonzero(left[i])
        exact = distances(queries[i], vectors[at])
        yield int(query_ids[i]), heapq.nsmallest(k, zip(exact.tolist(), ids[at].tolist(), strict=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def nearest(df: DataFrame, is_query: Column, ident: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score (the distance) of each query's k nearest rows."""
    rows = usable(df, ident, vector)
    wanted = usable(df.where(is_query), ident, vector)
    n, n_queries = rows.count(), wanted.count()
    tiles, query_blocks = max(1, -(-n // TILE)), max(1, -(-n_queries // QUERY_BLOCK))
    tile, block = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    candidates = rows.select(F.size("v").alias("dim"), tile.alias("tile"), every(query_blocks).alias("block"), "id", "v")
    asked = wanted.select(F.size("v").alias("dim"), every(tiles).alias("tile"), block.alias("block"), "id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            ids, vectors, asked_ids, asked_vectors = left["id"].to_numpy(), _matrix(left["v"]), right["id"].to_numpy(), _matrix(right["v"])
            step = max(1, CELLS // len(ids))
            for i in range(0, len(asked_ids), step):
                for query, heap in tile_heaps(asked_ids[i : i + step], asked_vectors[i : i + step], ids, vectors, k):
                    out += [(query, j, d) for d, j in heap]
        query, vec, score = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    keys = ["dim", "tile", "block"]
    found = candidates.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")

    def merge(own: pa.Table) -> pa.Table:
        best = heapq.nsmallest(k, zip(own["score"].to_pylist(), own["vec_id"].to_pylist(), strict=True))
        score, vec = zip(*best, strict=True)
        query = [own["query_id"][0].as_py()] * len(best)
        return pa.table({
            "query_id": pa.array(query, pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()),
            "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64()),
        })

    return found.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
