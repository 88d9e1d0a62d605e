"""Memory of Python workers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch that a worker is sent, one row at least; a task's JVM and its worker each hold one whole.
BATCH = 15 << 18
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Lists that modules fill and can fill again: emptied between tasks.
CACHES: list[list] = []


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` of small batches: the session's limit of bytes is set to BATCH, unless the session was given one."""
    spark = df.sparkSession
    if not spark.conf._jconf.contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, f"{BATCH}b")
    return df.mapInArrow(run, schema)


def release() -> None:
    """Give memory that was freed back to the system, where the allocators can."""
    for cache in CACHES:
        cache.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that releases what the worker's last task left, and its own when done: Spark keeps its workers."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def slices(batch: pa.RecordBatch, text: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose column ``text`` holds about ``limit`` bytes, so that Python objects are made of a run alone."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    lo = 0
    while lo < len(end):
        done = end[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(end, done + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
