"""Integer vectors: cleaning on the JVM, matrices in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(vector: Column, scale: int, limit: int) -> Column:
    """floor(scale * x) of each component as array<int> (array<bigint> where ``limit`` fits no int); null for a
    null vector, and where a component is null, not finite, or beyond ``limit`` after scaling."""
    x = vector.cast("array<double>")
    fits = F.forall(x, lambda v: F.coalesce(F.abs(v * scale) <= limit, F.lit(False)) & ~F.isnan(F.coalesce(v, F.lit(0.0))))
    return F.when(fits, F.transform(x, lambda v: F.floor(v * scale).cast("int" if limit < 1 << 31 else "bigint")))


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """int64 rows of a list column, padded with zeros to ``width`` or to the longest."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks else pa.array([], column.type)
    off = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False).astype(np.int64)
    lens = np.diff(off)
    width = width if width is not None else int(lens.max(initial=0))
    if (lens == width).all():
        return flat.reshape(len(lens), width)
    out = np.zeros((len(lens), width), np.int64)
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], lens)] = flat
    return out
