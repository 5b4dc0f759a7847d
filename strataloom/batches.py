"""Arrow batches of bounded size on their way through tasks."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: UTF-8 bytes of text, and rows, that an operator works on at a time.
SLICE_BYTES = 2 << 20
SLICE_ROWS = 4096
#: Bytes of an Arrow batch: it is held several times over on its way through a task.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's default and the values set here.
_ours = {"67108864b"}


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Arrow batches of ``size`` where the session still has Spark's default of 64 MB, or more from here.

    The setting is read when a plan runs, after an operator has returned, so it
    stays in the session; a value that the caller has chosen is left alone.
    """
    now = spark.conf.get(_BATCH_KEY, None)
    if now in _ours and int(now.rstrip("b")) > size:
        spark.conf.set(_BATCH_KEY, str(size))
        _ours.add(str(size))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return what Arrow and the C library have freed, but keep, to the system.

    A worker outlives its task, and what its allocators keep counts against the
    executor beside the workers of other tasks.
    """
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batches, *texts: int, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS):
    """The batches cut so that a piece has about ``limit`` bytes in the columns ``texts``.

    A batch has as many bytes as the session allows; an operator's own arrays
    are many times its texts, so it takes less at a time.  A row is never cut: a
    longer text is a piece of its own.  After the last batch memory that is free
    goes back to the system.
    """
    for b in batches:
        size = np.zeros(b.num_rows, dtype=np.int64)
        for i in texts:
            size += pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < b.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
            stop = max(at + 1, min(stop, at + rows))
            yield b.slice(at, stop - at)
            at = stop
    give_back()


def append_columns(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """The batch with further columns at its end."""
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], names=[*batch.schema.names, *columns]
    )
