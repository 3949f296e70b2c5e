"""Helpers for text columns seen as one byte buffer with offsets, inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null rows are empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or column.type != pa.large_string() else column
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for lengths[0] values, then the same for the next."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def row_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each; a longer row stands alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp values of every run of `width` elements (modulo 2**64), by doubling; shorter than the input by width - 1."""
    power, have, out, done = values, 1, None, 0
    left = width
    while left:
        if left & 1:
            n = len(values) - done - have + 1
            if n <= 0:
                return np.empty(0, np.uint64)
            part = power[done : done + n]
            out = part if out is None else out[:n] * np.uint64(pow(base, have, 1 << 64)) + part
            done += have
        left >>= 1
        if left:
            if len(power) <= have:
                return np.empty(0, np.uint64)
            power = power[:-have] * np.uint64(pow(base, have, 1 << 64)) + power[have:]
            have *= 2
    return out[: len(values) - width + 1]
