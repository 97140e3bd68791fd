"""Small helpers for operators that run over Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from likeness.runtime import ship

#: Characters of text that one step of an operator holds at a time.
CHUNK_CHARS = 4_000_000


def give_back() -> None:
    """Hand memory that a task has freed back to the system: the Python workers live on, for the next operator's tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_docs(
    docs: DataFrame,
    start: Callable[[], Callable[[list], dict]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_row: bool = False,
    carry: tuple[str, ...] = (),
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """Apply a function on lists of texts to every document, in bounded chunks.

    ``start()`` is called once per task and returns ``f(texts) -> {column: values}``.
    The result has the id and the columns of ``schema``; with ``keep_row`` also
    ``_row``, a struct of all the input's columns, so that no name can clash.
    The columns named in ``carry`` are returned as they are.
    A null text counts as the empty text. Other columns are neither read nor
    returned. Rows repeat as often as they did in the input.
    """
    ship(docs.sparkSession)
    cols = [F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text")]
    cols += [F.col(f"`{c}`") for c in carry]
    if keep_row:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    src = docs.select(*cols)
    made = StructType.fromDDL(schema)
    names = made.names
    rest = [*carry, *["_row"] * keep_row]
    out = StructType([StructField(id_col, src.schema["_id"].dataType), *made.fields, *(src.schema[c] for c in rest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for b in batches:
            texts = b.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= chunk_chars):
                    size += len(texts[hi])
                    hi += 1
                got = f(texts[lo:hi])
                part = b.slice(lo, hi - lo)
                arrays = [part.column(0), *(got[n] for n in names)]
                arrays = [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a) for a in arrays]
                yield pa.RecordBatch.from_arrays([*arrays, *part.columns[2:]], names=[id_col, *names, *rest])
                del got, part, arrays
                lo = hi
            del b, texts
            give_back()

    return src.mapInArrow(run, out)


def binaries(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of ``flat`` that end at ``ends`` (counted in items), as a binary column."""
    offsets = np.zeros(len(ends) + 1, np.int64)
    offsets[1:] = np.asarray(ends, np.int64) * flat.itemsize
    data = np.ascontiguousarray(flat)
    if offsets[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pa.array([data[a // flat.itemsize : b // flat.itemsize].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
