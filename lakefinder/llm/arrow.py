"""What functions over Arrow batches share: bounded batches, and memory given back when a task ends."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch, at most (one row at least): texts can be long, and a Python worker holds a batch at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in this session, which is where Spark looks when it makes a plan; smaller bounds are kept."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if now <= 0 or now > most:
            spark.conf.set(key, most)


def give_back() -> None:
    """Return free memory to the system: workers are kept between tasks, so what one holds the next tasks' workers lack."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Run) -> Run:
    """``run`` for ``mapInArrow``, with its memory given back at the task's end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
