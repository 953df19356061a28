"""Helpers shared by the corpus operators.

Row identity.  Operators never rely on a table's other columns: they select what
they need under names of their own, so extra or clashing columns do no harm.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import clear, discard, remove, scratch, shared_dir, stash

#: Rows, and bytes of text, that one slice holds at most while a Python stage works on it; a longer text is alone.
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20


def fresh(taken: list[str], base: str) -> str:
    """``base``, with underscores added until no column of ``taken`` has that name."""
    lowered = {c.lower() for c in taken}
    while base.lower() in lowered:
        base += "_"
    return base


def column(df: DataFrame, name: str) -> Column:
    """The column of that very name, even if it holds dots."""
    return df["`" + name.replace("`", "``") + "`"]


def _binary(batch_column: pa.Array) -> list:
    if pa.types.is_large_string(batch_column.type):
        return batch_column.cast(pa.large_binary()).to_pylist()
    return batch_column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most SLICE_ROWS rows and SLICE_BYTES bytes in column ``text``, but one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    past = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = past[start] - sizes[start]
        stop = int(np.searchsorted(past, before + SLICE_BYTES, side="right"))
        stop = max(start + 1, min(stop, start + SLICE_ROWS, batch.num_rows))
        yield batch.slice(start, stop - start)
        start = stop


def release() -> None:
    """Give the memory that a task no longer uses back: its Python worker stays, and waits beside stages that run in the JVM alone."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _run(make, text, also, names, types, batches):
    work = make()
    try:
        for batch in batches:
            for piece in slices(batch, text):
                got = work(_binary(piece.column(text)), *[piece.column(i).to_pylist() for i in also])
                arrays = [piece.column(i) for i in range(piece.num_columns)]
                arrays += [pa.array(got[n], type=t) for n, t in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=piece.schema.names + names)
    finally:
        del work
        release()


def append_columns(df: DataFrame, text: str, added: T.StructType, make: Callable, also: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with columns computed from the UTF-8 bytes of its column ``text``.

    ``make()`` runs once in each task and returns a function from a list of bytes (or
    None), and the lists of the columns ``also``, to a dict of equally long lists, one
    for each field of ``added``.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in added.fields]
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = functools.partial(
        _run, make, df.columns.index(text), [df.columns.index(c) for c in also], added.names, types
    )
    fields = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields + added.fields]
    return df.mapInArrow(run, T.StructType(fields))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """An equality of all ``keys`` under which null equals null."""
    return functools.reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


__all__ = ["F", "T", "append_columns", "clear", "column", "discard", "documents", "fresh", "null_safe", "release", "remove", "scratch", "shared_dir", "slices", "stash"]
