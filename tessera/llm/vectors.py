"""Vectors as whole numbers: what the exact vector operators (11, 12) share.

Parts are floor(scale * x), x in double precision. Sums of products stay exact: in float32 or float64 matrix products where no
sum can pass 2^24 or 2^53, else in 64-bit integers; parts so large that a sum doesn't fit 64 bits are an arithmetic error.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(vector: str) -> Column:
    """Whether a vector is there, with neither null nor non-finite parts."""
    return F.coalesce(F.expr(f"{vector} is not null and forall({vector}, x -> x is not null and x = x and abs(x) < double('infinity'))"), F.lit(False))


def scaled(vector: str, scale: int) -> Column:
    return F.expr(f"transform({vector}, x -> cast(floor({scale}D * cast(x as double)) as bigint))")


class Range(NamedTuple):
    """Rows, the longest vector, the largest part and a bound of the largest squared norm of a table of whole vectors `v`."""

    rows: int
    dims: int
    part: int
    norm: float


def range_of(df: DataFrame) -> Range:
    """One pass. Parts whose sums of products could leave 64 bits are an arithmetic error."""
    part = F.aggregate("v", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x)))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    own = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), F.max(part).alias("p"), F.max(norm).alias("q")).first()
    found = Range(int(own["n"]), int(own["d"] or 0), int(own["p"] or 0), float(own["q"] or 0) * (1 + 1e-9))
    if 4 * max(1, found.dims) * found.part**2 >= 1 << 63:
        raise OverflowError(f"sums of products of {found.dims} parts of up to {found.part} don't fit 64 bits")
    return found


def exact_type(most: int) -> type:
    """In which matrix products are exact, if no sum passes `most`."""
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def packed_type(found: Range) -> str:
    """The smallest integers that hold all parts."""
    return "<i2" if found.part < 1 << 15 else "<i4" if found.part < 1 << 31 else "<i8"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long lists of whole numbers, as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), -1)


def of_bytes(column: pa.Array | pa.ChunkedArray, dtype: str) -> np.ndarray:
    """Equally long packed vectors, as rows."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1)
