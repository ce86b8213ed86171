"""Helpers that look at whole Arrow text columns through numpy, without Python strings."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that are worked on at once; a longer single text is one block.
BLOCK_BYTES = 4 << 20
#: Bytes of a batch that goes to a Python worker; Spark's own bound lets through much more.
BATCH_BYTES, BATCH_SETTING, SPARKS_OWN = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on bounds batches by BATCH_BYTES, unless it has a bound of its own.

    A batch is at least one row, and stands in the memory of both the JVM and the worker.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) in (None, str(SPARKS_OWN), f"{SPARKS_OWN}b"):
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def hand_back() -> None:
    """Hands memory that this process does not use back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no such library call here
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A worker's function over batches that hands unused memory back to the system at its end.

    Workers live on between tasks; an idle one should not hold what its last task needed.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        hand_back()

    return tidied


def utf8_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets as int64, bytes as uint8) of a text column; null counts as empty.

    The offsets start at 0 and the bytes hold exactly the texts, one after another.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64) if offsets is not None and offsets.size else np.zeros(len(column) + 1, np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], body[at[0] : at[-1]]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of at most ``limit`` bytes, or one row that is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all ranges [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (ends - lengths), lengths)
    return out


def whole_runs(batches: Iterator[pa.RecordBatch], key: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about so many rows from sorted batches; rows of one key are never parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            values = np.stack([table.column(c).to_numpy() for c in key])
            cut = np.flatnonzero((values != values[:, -1:]).any(axis=0))
            at = int(cut[-1]) + 1 if len(cut) else 0
            if at:
                yield table.slice(0, at)
            held = table.slice(at).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
