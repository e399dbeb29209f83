"""Text columns as flat byte arrays inside tasks, and the shared folder that jobs write to.

Arrow hands a task its rows as one buffer of UTF-8 bytes and one of offsets. The operators of this folder work on these
two arrays with numpy, many documents at a time, instead of on one Python string after the other.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds as numpy arrays at a time (a longer document is a block of its own).
BLOCK_BYTES = 1 << 20

#: [\x20\x09-\x0D], the bytes between words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class Block(NamedTuple):
    """Rows `first` and on of a batch: bounds[i]:bounds[i + 1] are the bytes of row i."""

    batch: pa.RecordBatch
    data: np.ndarray
    bounds: np.ndarray

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))

    def longs(self, name: str) -> np.ndarray:
        return np.asarray(self.column(name).to_numpy(zero_copy_only=False), np.int64)

    def texts(self, name: str = "text") -> list[str]:
        return [x or "" for x in self.column(name).to_pylist()]


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES, rows: int = 1 << 20) -> Iterator[Block]:
    """Cuts batches into blocks of at most `most` bytes of text and of `rows` rows; null texts count as empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        column = pc.fill_null(column, "")
        n = len(column)
        if not n:
            continue
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
            to = min(to, n, at + rows)
            low, high = int(bounds[at]), int(bounds[to])
            yield Block(batch.slice(at, to - at), data[low:high], bounds[at : to + 1] - low)
            at = to
    released()


def released() -> None:
    """Gives memory that is free back to the system: a task's Python process serves later tasks of other kinds too."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc() -> ctypes.CDLL | None:
    try:
        out = ctypes.CDLL("libc.so.6")
        return out if hasattr(out, "malloc_trim") else None
    except OSError:  # another C library
        return None


_LIBC = _libc()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that all their bits look random (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def loads(data: np.ndarray, size: int = 8) -> np.ndarray:
    """The `size` (8 at most) bytes from each position on as one number; zeros stand after the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.ndarray(len(data), "<u8", padded, strides=(1,))
    return out & _mask(size) if size < 8 else np.ascontiguousarray(out)


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << (8 * size)) - 1)


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def pair(a: np.ndarray, b: np.ndarray, seed: np.uint64 = _ODD) -> np.ndarray:
    """A hash of two 64-bit values in their order."""
    return mixed(mixed(a + seed) ^ b)


def in_a_row(values: np.ndarray, n: int, step: int = 1, seed: np.uint64 = _ODD) -> np.ndarray:
    """Hashes of n values that stand `step` apart, by where the first stands: by doubling, so that a hash of 2k values is that
    of two hashes of k (hashes that are sums of powers would be equal for some words in another order)."""
    if len(values) <= (n - 1) * step:
        return np.zeros(0, np.uint64)
    have, level, out, covered = 1, values, None, 0
    rest = n
    while rest:
        if rest & 1:
            ahead = level[covered * step :]
            out = ahead if out is None else pair(out[: len(ahead)], ahead, seed)
            covered += have
        rest >>= 1
        if rest:
            level = pair(level[: -have * step], level[have * step :], seed)
            have *= 2
    return out[: len(values) - (n - 1) * step]


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n bytes in a row, by where they start (n up to 8, or a multiple of 8)."""
    count = max(0, len(data) - n + 1)
    if n <= 8:
        return mixed(loads(data, n)[:count])
    return in_a_row(mixed(loads(data)[: len(data) - 7]), n // 8, 8)[:count] if count else np.zeros(0, np.uint64)


#: Bytes from which a piece is hashed by itself, as a whole.
LONG = 64


#: Seed of the second of two 64-bit hashes, which go their own ways from the first byte on.
TWIN = np.uint64(0xA0761D6478BD642F)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.uint64 = _ODD) -> np.ndarray:
    """64-bit hashes of data[start:end]: 8 bytes after the other, each mixed into what was before. A step can be solved for
    the bytes that collide, so what must be told apart takes two of them, with different seeds."""
    size = end - start
    out = mixed(size.astype(np.uint64) + seed)
    view = loads(data)
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left, own = start[live], size[live], out[live]
    while len(live):
        own = mixed(own ^ mixed(view[at] & _MASKS[np.minimum(left, 8)]))
        out[live] = own
        more = left > 8
        live, at, left, own = live[more], at[more] + 8, left[more] - 8, own[more]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, salt=int(seed).to_bytes(8, "little")).digest(), "little")
    return out


class Words(NamedTuple):
    """Words of a block: bytes start:end, and the row each belongs to; first[i]:first[i + 1] are the words of row i."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    twin: np.ndarray | None


def words(data: np.ndarray, bounds: np.ndarray, twin: bool = False) -> Words:
    """Words are the longest runs without separators; they never cross rows. With twin, also their second hashes."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(SEPARATOR[data], out=inside[1:-1])
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    begins[inner] = inside[1:-1][inner]
    ends[inner - 1] = inside[1:-1][inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(start, end, row, first, byte_hashes(data, start, end), byte_hashes(data, start, end, TWIN) if twin else None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a folder of this machine is set in local mode (tests);
    on a cluster that would be one that other machines can't read, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str) -> DataFrame:
    """As `written`, in buckets by `part`: groups by part read them where they are, without a shuffle."""
    spark = df.sparkSession
    name = f"{what}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.format("parquet").bucketBy(partitions(spark), "part").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def forgotten(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, and the catalog's entry of bucketed ones."""
    for df in tables:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            if "-" not in path.getName() and spark.catalog.tableExists(path.getName()):
                spark.sql(f"DROP TABLE {path.getName()}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def narrowed(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: others, also of clashing names, can't get in the way."""
    return docs.select(*[F.col(n) for n in names])
