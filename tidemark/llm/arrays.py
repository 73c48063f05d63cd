"""Text columns as numpy arrays, in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 2 << 20
PART_ROWS = 4096


def parts(column: pa.Array, rows: int = PART_ROWS) -> Iterator[pa.Array]:
    """The column in slices of about PART_BYTES bytes and so many rows at most, a longer text being a slice of its own; null becomes empty."""
    column = column.fill_null("").cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + PART_BYTES, "right"))))
        yield column.slice(at, stop - at)
        at = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_string column end to end, and where each text starts (with the end of the last)."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, stop) of pieces of about PART_BYTES bytes that cover a text; each ends behind an ASCII space where there is one near."""
    at = 0
    while len(raw) - at > PART_BYTES:
        stop = at + PART_BYTES
        spaces = np.flatnonzero(raw[stop - 4096 : stop] == 32)
        stop += int(spaces[-1]) - 4095 if len(spaces) else 0
        yield at, stop
        at = stop
    yield at, len(raw)
