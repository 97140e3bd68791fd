"""What both vector searches share: which rows take part, shards, and query blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Every row whose id this divides is a query.
EVERY = 50


def usable(rows: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(vec_id, v) of the rows that take part: v an array of doubles without null or non-finite components, and not all zero if ``nonzero``."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    out = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = out.where(fine)
    return out.where(F.exists("v", lambda x: x != 0)) if nonzero else out


def shards_of(n: int, rows: int) -> int:
    return max(1, -(-n // rows))


def matrix(column, width: int | None = None) -> np.ndarray:
    """A list column as a matrix; components that a shorter list lacks count as 0."""
    arr = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    n = len(arr)
    if not n:
        return np.zeros((0, width or 1))
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    lens = pc.list_value_length(arr).to_numpy(zero_copy_only=False)
    width = max(width or 0, int(lens.max()))
    if (lens == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width), flat.dtype)
    row = np.repeat(np.arange(n), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def both(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Two list columns as matrices of one width."""
    x, y = matrix(a), matrix(b)
    width = max(x.shape[1], y.shape[1])
    return matrix(a, width), matrix(b, width)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two matrices, in doubles, component by component in order; between -1 and 1."""
    dot, na, nb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for i in range(a.shape[1]):
        x, y = a[:, i], b[:, i]
        dot, na, nb = dot + x * y, na + x * x, nb + y * y
    return np.clip(dot / np.sqrt(na * nb), -1.0, 1.0)
