"""Small helpers for functions that work on Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
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


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a worker that lives on between tasks: it keeps no memory when a task or group has ended."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tidy(False)
        try:
            yield from run(batches)
        finally:
            _tidy(True)

    return inner


def lean_table(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """lean() for a function of whole groups."""

    @functools.wraps(run)
    def inner(*args: object) -> pa.Table:
        _tidy(False)
        try:
            return run(*args)
        finally:
            _tidy(True)

    return inner


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow() with a lean() worker and small batches, as rows may hold long texts.

    The session's batch size is lowered where it is larger, for what the session runs later too; results
    don't depend on it.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_RECORDS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_RECORDS)
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) != str(BATCH_BYTES):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(lean(run), schema)


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``limit`` bytes in each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy().astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null is empty."""
    if values.null_count:
        values = values.fill_null("" if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else b"")
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    offsets = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = values.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An array of binary values cut from ``data`` at ``offsets``."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """data[starts[0] : starts[0] + lengths[0]], then the next piece, and so on, in one array."""
    total = int(lengths.sum())
    if not total:
        return data[:0]
    before = np.cumsum(lengths) - lengths
    return data[np.repeat(starts - before, lengths) + np.arange(total)]
