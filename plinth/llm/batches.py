"""Arrow batches in Python workers.

Spark's batches hold 10,000 rows, which for long texts is more than a worker should get or expand at once. Workers are used again
and wait idle beside tasks that run no Python, so they return what a task took to the system when it ends.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch, but for single longer rows.
BATCH_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def bounded(batches: Iterator[pa.RecordBatch], text: int, most: int = 2 << 20, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and, but for single longer texts, ``most`` bytes of the text column."""
    for b in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(b.column(text)), 0).cast(pa.int64())).to_numpy() if b.num_rows else np.zeros(0, np.int64)
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, "right"))))
            yield b.slice(at, stop - at)
            at = stop


def give_back() -> None:
    """Free memory that the allocators hold goes back to the system. Other C libraries than glibc have no trim and need none."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with memory given back at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def through(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``rows.mapInArrow(run)`` with batches cut by bytes: each is there twice, in the JVM beside its heap and in the worker. Sets the session's limit, which is read when the job runs."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return rows.mapInArrow(tidy(run), schema)
