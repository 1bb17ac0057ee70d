"""Functions over Arrow batches inside tasks, with small batches and workers that keep no memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Records and bytes of an Arrow batch on its way to a worker and back.
BATCH_RECORDS, BATCH_BYTES = 2000, 4 << 20


def _tidy(ended: bool) -> None:
    """Let arrays of a megabyte or more go back to the system when they are dropped, and with ``ended`` all that is free."""
    library = ctypes.CDLL(None)
    if hasattr(library, "mallopt"):
        library.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())
    if ended and hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow() with small batches, as rows may hold whole runs or blocks; a worker keeps no memory when a task has ended.

    The session's batch size is lowered where it is larger, for what the session runs later too; results
    don't depend on it.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_RECORDS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_RECORDS)
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) != str(BATCH_BYTES):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tidy(False)
        try:
            yield from run(batches)
        finally:
            _tidy(True)

    return df.mapInArrow(lean, schema)
