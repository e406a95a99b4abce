"""Arrow string columns as raw UTF-8 bytes and offsets, cut into blocks of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once, and those of the machines that read many places of a block side by side; one longer text forms a block of its own.
BLOCK_BYTES, WIDE_BYTES = 1 << 20, 4 << 20


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls count as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()) if not pa.types.is_binary(column.type) else column, np.int32
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows of a batch in order, as (rows, bytes, offsets) of about `size` bytes of text each."""
    data, offsets = raw(batch.column(batch.schema.get_field_index(column)))
    begin, n = 0, batch.num_rows
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
        yield batch.slice(begin, end - begin), data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end
    trim()


def trim() -> None:
    """Give memory that is free back to the system: a worker lives on, and what its largest block took would stay with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
