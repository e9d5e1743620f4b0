"""Arrow text columns as byte buffers with offsets, in blocks of bounded size, for the vectorised operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LIBC = ctypes.CDLL(None)
#: Whitespace of the word rules: space and the controls 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each piece has at most ``max_bytes`` of text, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
            yield batch.slice(start, end - start)
            start = end
    release()


def release() -> None:
    """Gives free memory back to the system: workers live on, beside the JVM and those of other stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the row offsets into them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of ``data`` between neighbouring offsets, without a copy."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each row; rows may be empty."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=np.int64)
    return out


class Words:
    """The runs of bytes in ``keep`` of each row. Runs end at row ends.

    ``starts`` and ``ends`` are positions in the buffer, ``rows`` are offsets of each row's words among all words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray):
        at_row = np.zeros(len(data) + 1, bool)
        at_row[offsets] = True
        padded = np.zeros(len(data) + 2, bool)
        padded[1:-1] = keep
        self.starts = np.flatnonzero(padded[1:-1] & (~padded[:-2] | at_row[:-1]))
        self.ends = np.flatnonzero(padded[1:-1] & (~padded[2:] | at_row[1:])) + 1
        self.rows = np.searchsorted(self.starts, offsets)
        self._data, self._keep = data, keep

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def array(self) -> pa.Array:
        """The words as a binary array."""
        lengths = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=lengths[1:])
        return binary_array(self._data[self._keep], lengths)

    def ids(self) -> np.ndarray:
        """Equal numbers for equal words."""
        return self.array().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def row_numbers(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
