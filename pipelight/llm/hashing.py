"""Vectorised hashing of Arrow batches of texts: units (bytes or words) in, 64-bit hashes out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes that one numpy pass treats at once; bounds the memory of a worker.
SLICE_BYTES = 1 << 19
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i, modulo 2 ** 64, for i up to n."""
    if _powers.get("n", np.empty(0)).size <= n:
        size = 1 << max(12, int(n).bit_length())
        for name, base in (("n", _BASE), ("inverse", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["n"], _powers["inverse"]


def prefix_sums(units: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes of 64-bit units: entry i covers units[:i]."""
    out = np.zeros(units.size + 1, dtype=np.uint64)
    np.cumsum(units * powers(units.size)[0][: units.size], out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of units[start:end], alike for equal units wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(sums.size)[1][start] + (end - start).astype(np.uint64) * _BASE)


def pieces(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about `most` bytes.

    A null is empty.  A single longer text makes a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


_rng = np.random.default_rng(20240607)
BYTE_UNITS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without white space) of texts that stand one after another in data.

    Returns each word's hash, its first byte and the byte after it, and for each text the number of
    words before it (one entry more than there are texts).
    """
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < data.size)]
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    begins[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = prefix_sums(BYTE_UNITS[data])
    return ranges(sums, start, end), start, end, np.searchsorted(start, offsets, side="left")
