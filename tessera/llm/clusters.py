"""Centroid clustering of whole vectors (operator 12).

Method: Lloyd's rounds with Drake's adaptive bounds. Each vector keeps an upper bound of the distance to its own centroid,
lower bounds of the distances to its next `bounds` centroids in the order in which they stood, and one lower bound that holds
for all the rest. When centroids move, the bounds move by as much. In a round a vector finds the first place from which on all
its lower bounds are above the upper one: at place 0 nothing is computed, else the upper bound is made exact; if the order
still can't be certified, only the centroids before that place are compared again, or all of them if the last bound fails too.
The next round keeps as many bounds as this one needed (an eighth of the centroids at least). A bound certifies only with a margin far above
rounding errors, and what isn't certified is decided by squared distances in whole numbers: the result is that of comparing all.

Vectors are dealt once into blocks that are bucketed; bounds lie in a second bucketed table that each round writes again, so a round reads
the vectors where they are, without a shuffle, and writes what the bounds and each block's sums per centroid need. Sums are added per centroid and part
by a grouping; the driver gets centroids x parts whole numbers and the number of vectors, no rows. Each round starts from written
tables: a lost executor costs the blocks it was working on.

Edge cases: rows whose vector is null, of another length, or holds null or non-finite parts are left out; each row counts,
also of one vec_id, or without one (those are no seeds); of seeds of one vec_id the smallest vector is taken; fewer vectors
than centroids give as many centroids as there are ids; equal distances go to the smaller number, equal seeds leave the later ones empty;
a centroid without vectors stays; parts whose squared distances don't fit 64 bits are an arithmetic error; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.blocks import bucketed, forgotten, written
from tessera.llm.vectors import exact_type, fit, matrix, packed_type, range_of, scaled

#: Vectors of a block, at most.
BLOCK = 4096

_BLOCK = "part long, n int, ids binary, named binary, vectors binary"
_STATE = "part long, state binary, sums array<long>, counts array<long>, deepest int, compared long"
RESULT = "vec_id long, cluster int, distance long"


class State(NamedTuple):
    """Of a block: own centroid, upper bound; numbers and lower bounds of the next ones in order; the bound of the rest."""

    own: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    rest: np.ndarray

    def packed(self) -> bytes:
        head = np.array(self.near.shape, "<i8").tobytes()
        return head + b"".join(x.astype(t).tobytes() for x, t in zip(self, ("<i4", "<f8", "<i4", "<f8", "<f8"), strict=True))


def unpacked_state(raw: bytes) -> State:
    n, kept = np.frombuffer(raw, "<i8", 2)
    out, at = [], 16
    for dtype, shape in (("<i4", (n,)), ("<f8", (n,)), ("<i4", (n, kept)), ("<f8", (n, kept)), ("<f8", (n,))):
        out.append(np.frombuffer(raw, dtype, int(np.prod(shape)), at).reshape(shape))
        at += out[-1].nbytes
    return State(*out)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of whole vectors to all centroids, exact."""
    most = 4 * x.shape[1] * int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))) ** 2
    wide = exact_type(most)
    a, b = x.astype(wide), c.astype(wide)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def squared_to(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of row i of x to row i of c (or to rows c[i, :])."""
    d = c - (x if c.ndim == 2 else x[:, None, :])
    return (d * d).sum(-1)


def compared(x: np.ndarray, centroids: np.ndarray, kept: int) -> State:
    """The state of vectors after comparing all centroids; equal distances by number."""
    d = squared(x, centroids)
    order = np.argsort(d, axis=1, kind="stable")
    root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    rest = root[:, kept + 1] if root.shape[1] > kept + 1 else np.full(len(x), np.inf)
    return State(order[:, 0], root[:, 0], order[:, 1 : kept + 1], root[:, 1 : kept + 1], rest)


def moved(x: np.ndarray, old: State, centroids: np.ndarray, drift: np.ndarray, kept: int, slack: float) -> tuple[State, int, int]:
    """The state after centroids moved by at most `drift`, the deepest place that was needed, and how many distances were computed."""
    own, upper, near = old.own.copy(), old.upper + drift[old.own], old.near.copy()
    lower, rest = old.lower - drift[near], old.rest - drift.max(initial=0.0)

    def place(at: np.ndarray) -> np.ndarray:
        """The first place from which on all bounds are above the upper one: 0 to bounds + 1 (none)."""
        after = np.minimum.accumulate(np.column_stack([lower[at], rest[at]])[:, ::-1], axis=1)[:, ::-1]
        return (after <= (upper[at] + slack)[:, None]).sum(1)

    open_ = np.flatnonzero(place(np.arange(len(own))) > 0)
    upper[open_] = np.sqrt(squared_to(x[open_], centroids[own[open_]]).astype(np.float64))
    depth = place(open_)
    open_, depth, n_compared = open_[depth > 0], depth[depth > 0], len(open_)
    for z in range(1, near.shape[1] + 1):
        at = open_[depth == z]
        if not len(at):
            continue
        names = np.sort(np.column_stack([own[at], near[at, :z]]), axis=1)
        d = squared_to(x[at], centroids[names])
        order = np.argsort(d, axis=1, kind="stable")
        names, root = np.take_along_axis(names, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        own[at], upper[at], near[at, :z], lower[at, :z] = names[:, 0], root[:, 0], names[:, 1:], root[:, 1:]
        n_compared += names.size
    new = State(own, upper, near[:, :kept], lower[:, :kept], np.minimum(rest, lower[:, kept:].min(1)) if kept < near.shape[1] else rest)
    at = open_[depth > near.shape[1]]
    if len(at):
        fresh = compared(x[at], centroids, kept)
        for have, got in zip(new, fresh, strict=True):
            have[at] = got
        n_compared += len(at) * len(centroids)
    return new, int(depth.max(initial=0)), n_compared


def sums_of(x: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((k, x.shape[1]), np.int64)
    np.add.at(out, own, x)
    return out, np.bincount(own, minlength=k)


def dealt(df: DataFrame, ident: str, vector: str, dims: int, scale: int) -> tuple[DataFrame, DataFrame, str]:
    """The vectors that take part (id, v), and these as bucketed blocks, with the type of their numbers."""
    rows = df.where(fit(vector)).where(F.size(vector) == dims).select(F.col(ident).cast("long").alias("id"), scaled(vector, scale).alias("v"))
    dtype = packed_type(range_of(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                own = batch.slice(low, BLOCK)
                task = own.column(2)[0].as_py()
                ids = own.column(0)
                yield pa.RecordBatch.from_arrays([
                    pa.array([(task << 32) + nth], pa.int64()), pa.array([own.num_rows], pa.int32()),
                    pa.array([np.asarray(ids.fill_null(0), "<i8").tobytes()], pa.binary()), pa.array([np.asarray(ids.is_valid(), bool).tobytes()], pa.binary()),
                    pa.array([matrix(own.column(1)).astype(dtype).tobytes()], pa.binary()),
                ], ["part", "n", "ids", "named", "vectors"])
                nth += 1

    return rows, bucketed(rows.withColumn("task", F.spark_partition_id()).mapInArrow(run, _BLOCK), "vectors"), dtype


def seeds(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors of the k ids with the smallest SHA-256 of `seed:id`, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.where("id is not null").select(key.alias("key"), "id").distinct().orderBy("key").limit(k)
    found = rows.join(F.broadcast(first), "id").groupBy("key").agg(F.min("v").alias("v")).orderBy("key").collect()
    return np.array([r["v"] for r in found], np.int64)


def _vectors(own: pa.Table, dims: int, dtype: str) -> np.ndarray:
    """Of a group, which is one block."""
    return np.frombuffer(own["vectors"][0].as_py(), dtype).reshape(-1, dims).astype(np.int64)


def _state_row(own: pa.Table, x: np.ndarray, state: State, k: int, deepest: int, n: int) -> pa.Table:
    sums, counts = sums_of(x, state.own, k)
    return pa.table({
        "part": own["part"], "state": pa.array([state.packed()], pa.binary()), "sums": pa.array([sums.ravel().tolist()], pa.list_(pa.int64())),
        "counts": pa.array([counts.tolist()], pa.list_(pa.int64())), "deepest": pa.array([deepest], pa.int32()), "compared": pa.array([n], pa.int64()),
    })


class Clustered(NamedTuple):
    """Rows of RESULT, the last centroids, and how many distances to centroids each round computed."""

    rows: DataFrame
    centroids: np.ndarray
    compared: list[int]


def clustered(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: str = "3") -> Clustered:
    spark = df.sparkSession
    rows, blocks, dtype = dealt(df, ident, vector, dims, scale)
    centroids = seeds(rows, k, seed)
    k = len(centroids)
    if not k:
        return Clustered(spark.createDataFrame([], RESULT), centroids, [])
    kept = _fewest(k) if k < 4 else max(_fewest(k), k // 2)

    def begin(own: pa.Table) -> pa.Table:
        x = _vectors(own, dims, dtype)
        return _state_row(own, x, compared(x, centroids, kept), k, 0, len(x) * k)

    tables = [bucketed(blocks.groupBy("part").applyInArrow(begin, _STATE), "bounds")]
    work: list[int] = []
    for _ in range(rounds):
        sums, counts, deepest, n = _totals(tables[-1], k, dims)
        work.append(n)
        kept = max(_fewest(k), min(kept, deepest)) if len(work) > 1 else kept
        after = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1).astype(object)[:, None], centroids).astype(np.int64)
        drift = np.sqrt(((after - centroids).astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
        centroids = after
        tables.append(bucketed(_moved(blocks, tables[-1], centroids, drift, kept, dims, dtype), "bounds"))
        forgotten(tables[-2])
    work.append(_totals(tables[-1], k, dims)[3])
    found = written(_rows(blocks, tables[-1], centroids, dims, dtype), "clustered")
    forgotten(blocks, tables[-1])
    return Clustered(found, centroids, work)


def _fewest(k: int) -> int:
    """Bounds that are kept at least: an eighth of the centroids."""
    return min(k - 1, max(1, -(-k // 8)))


def _moved(blocks: DataFrame, bounds: DataFrame, centroids: np.ndarray, drift: np.ndarray, kept: int, dims: int, dtype: str) -> DataFrame:
    def run(own: pa.Table, states: pa.Table) -> pa.Table:
        x = _vectors(own, dims, dtype)
        reach = max(float(np.abs(x).max(initial=0)), float(np.abs(centroids).max(initial=0)))
        state, deepest, n = moved(x, unpacked_state(states["state"][0].as_py()), centroids, drift, kept, slack=1e-9 * (1 + reach * np.sqrt(dims)))
        return _state_row(own, x, state, len(centroids), deepest, n)

    return blocks.groupBy("part").cogroup(bounds.groupBy("part")).applyInArrow(run, _STATE)


def _totals(bounds: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Sums and counts per centroid (added up per part before anything is shuffled), the deepest place, distances computed."""
    every = bounds.select(F.posexplode(F.concat("sums", "counts")).alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    values = np.zeros(k * (dims + 1), object)
    for r in every.collect():
        values[r["at"]] = int(r["x"])
    last = bounds.agg(F.max("deepest").alias("deepest"), F.sum("compared").alias("n")).first()
    return values[: k * dims].reshape(k, dims), values[k * dims :].astype(np.int64), int(last["deepest"]), int(last["n"])


def _rows(blocks: DataFrame, bounds: DataFrame, centroids: np.ndarray, dims: int, dtype: str) -> DataFrame:
    def run(own: pa.Table, states: pa.Table) -> pa.Table:
        ids, named = np.frombuffer(own["ids"][0].as_py(), "<i8"), np.frombuffer(own["named"][0].as_py(), bool)
        x, cluster = _vectors(own, dims, dtype), unpacked_state(states["state"][0].as_py()).own
        return pa.table({"vec_id": pa.array(ids, mask=~named), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(squared_to(x, centroids[cluster]), pa.int64())})

    return blocks.groupBy("part").cogroup(bounds.groupBy("part")).applyInArrow(run, RESULT)


def described(spark: SparkSession, found: Clustered) -> DataFrame:
    """The rows with the sum of distances of their cluster and of all, and SHA-256 of their centroid's numbers."""
    digest = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in found.centroids]
    inertia = {r["cluster"]: int(r["d"]) for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = sum(inertia.values())
    per = spark.createDataFrame([(i, inertia.get(i, 0), whole, d) for i, d in enumerate(digest)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
