"""Shuffles of many small rows as few large ones.

Fingerprints come in hundreds per document. Instead of a row each, a task packs the fingerprints that go to one part into
one binary value; Spark shuffles these by part, and the receiving task unpacks them as numpy arrays. There are as many
parts as shuffle partitions (and one more), and a task packs once for all of its rows: so there are no more packed rows
than blocks of a shuffle, and a task's memory is one part (its texts or its fingerprints), whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import Block, blocks, mixed, narrowed, partitions

PACKED = "part int, payload binary"

#: Values that a task gathers before it packs them.
GATHER = 1 << 20


def squeezed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True) if data else b""


def loosened(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def parts_of(df: DataFrame) -> int:
    """An odd number of parts (ids often step by an even number)."""
    return partitions(df.sparkSession) // 2 * 2 + 1


def hash_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """By the upper bits of 64-bit hashes, mixed once more: anchors are smallest hashes, whose own upper bits are all low."""
    return ((mixed(keys) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def packed(part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each part: the columns' values that go there, each column as its bytes one after the other."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(cuts[1:], len(part))
    sorted_columns = [c[order] for c in columns]
    payload = [b"".join([int(b - a).to_bytes(8, "little"), *(c[a:b].tobytes() for c in sorted_columns)]) for a, b in zip(cuts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int32()), pa.array(payload, pa.binary())], ["part", "payload"])


def gathered(pieces: Iterable[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """`packed` over many (part, columns...) of a task, GATHER values at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for piece in pieces:
        if len(piece[0]):
            held.append(piece)
            n += len(piece[0])
        if n >= GATHER:
            yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))


def unpacked(payloads: Iterable[bytes], *dtypes: type) -> list[np.ndarray]:
    """The columns again, over all payloads."""
    found: list[list[np.ndarray]] = [[] for _ in dtypes]
    for own in payloads:
        n, at = int.from_bytes(own[:8], "little"), 8
        for out, dtype in zip(found, dtypes, strict=True):
            out.append(np.frombuffer(own, dtype, n, at))
            at += n * np.dtype(dtype).itemsize
    return [np.concatenate(x) if x else np.zeros(0, d) for x, d in zip(found, dtypes, strict=True)]


def met(df: DataFrame, meet: Callable[[list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Groups packed rows by part and gives each group's payloads to `meet`."""

    def run(own: pa.Table) -> pa.Table:
        out = list(meet(own["payload"].to_pylist()))
        return pa.Table.from_batches(out) if out else empty

    empty = _empty(schema)
    return df.groupBy("part").applyInArrow(run, schema)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def _empty(schema: str) -> pa.Table:
    fields = [x.strip().split(" ") for x in schema.split(",")]
    return pa.schema([(n, _ARROW[k]) for n, k in fields]).empty_table()


#: Arrays that a task adds up at a time.
FAN_IN = 64


def tree_sum(df: DataFrame, dtype: str = "<i8") -> dict[int, np.ndarray]:
    """Sums of compressed arrays (`part`, `payload`: a row per task and part) by part, in rounds: no task adds up more than
    FAN_IN arrays, however many tasks there were."""

    def add(own: pa.Table) -> pa.Table:
        total = None
        for x in own["payload"].to_pylist():
            size = int.from_bytes(x[:8], "little")
            values = np.frombuffer(loosened(x[8:], size), dtype)
            total = values.copy() if total is None else total + values
        head = own.slice(0, 1)
        return pa.table({"part": head["part"].cast(pa.int32()), "place": head["place"].cast(pa.int32()), "payload": pa.array([array_payload(total)], pa.binary())})

    tasks = max(1, df.rdd.getNumPartitions())
    df = df.withColumn("place", F.spark_partition_id())
    while True:
        tasks = -(-tasks // FAN_IN)
        df = df.withColumn("place", F.floor(F.col("place") / FAN_IN).cast("int")).groupBy("part", "place").applyInArrow(add, "part int, place int, payload binary")
        if tasks == 1:
            break
    return {r["part"]: np.frombuffer(loosened(bytes(r["payload"][8:]), int.from_bytes(r["payload"][:8], "little")), dtype) for r in df.collect()}


def array_payload(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + squeezed(raw)


def array_rows(pieces: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each piece of an array, for `tree_sum`."""
    payload = [array_payload(x) for x in pieces]
    return pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(payload, pa.binary())], ["part", "payload"])


def packed_texts(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of doc_id and text as compressed blocks by part of doc_id. Null texts count as empty; rows without doc_id
    are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most=4 << 20):
            ids = block.longs("doc_id")
            part = np.mod(ids, parts)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
            payload = []
            for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                own = order[a:b]
                texts = b"".join(block.data[block.bounds[i] : block.bounds[i + 1]].tobytes() for i in own)
                head = np.concatenate([[len(own), len(texts)], ids[own], np.diff(block.bounds)[own]]).astype("<i8").tobytes()
                payload.append(head + squeezed(texts))
            yield pa.RecordBatch.from_arrays([pa.array(part[order][cuts], pa.int32()), pa.array(payload, pa.binary())], ["part", "payload"])

    known = narrowed(docs, "doc_id", "text").where(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
    return known.mapInArrow(run, PACKED)


def texts_of(payloads: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_id, data and bounds of each packed block."""
    for own in payloads:
        n, size = np.frombuffer(own, "<i8", 2)
        head = np.frombuffer(own, "<i8", 2 * n, 16)
        data = np.frombuffer(loosened(own[16 + 16 * n :], int(size)), np.uint8)
        yield head[:n], data, np.append(0, np.cumsum(head[n:]))


def with_texts(
    texts: DataFrame, other: DataFrame, meet: Callable[[Iterator, list[bytes]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Brings packed rows to the texts of their part: meet(blocks of texts, payloads)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(meet(texts_of(left["payload"].to_pylist()), right["payload"].to_pylist()))
        return pa.Table.from_batches(out) if out else empty

    empty = _empty(schema)
    return texts.groupBy("part").cogroup(other.groupBy("part")).applyInArrow(run, schema)


def together(left: DataFrame, right: DataFrame, meet: Callable[[list[bytes], list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Brings packed rows of two kinds together by part."""

    def run(own: pa.Table, other: pa.Table) -> pa.Table:
        out = list(meet(own["payload"].to_pylist(), other["payload"].to_pylist()))
        return pa.Table.from_batches(out) if out else empty

    empty = _empty(schema)
    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[Block, np.ndarray]]:
    """Blocks of rows with their ids."""
    for block in blocks(batches, most=most):
        yield block, block.longs("doc_id")
