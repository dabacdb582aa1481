"""Vectorised scans over the raw UTF-8 buffers of Arrow string columns.

Every function works on whole texts. Batches are cut into slices of about a megabyte, so that the
working arrays stay in cache and memory follows the slice, or the longest document where that is
larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_BYTES = np.arange(256)
_LETTERLIKE = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) | (_BYTES >= 128)
_NOT_WORD = ~_LETTERLIKE
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def _random_table(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_CODE = _random_table(11, 256)
_POWER = _random_table(12, 1024)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, own offsets) of runs of about SLICE_BYTES."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1
        j = min(max(j, i + 1), n, i + (1 << 18))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters of UTF-8."""
    out = _LOWER[data]
    at = np.flatnonzero(out[:-1] == 0xC3) + 1 if len(out) > 1 else np.zeros(0, np.int64)
    second = out[at]
    out[at] = np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), second + 0x20, second)
    return out


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes that are no separators; rows end runs too."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separators[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets) > 0)
    first, last = offsets[full], offsets[full + 1] - 1
    start[first] = inside[first]
    end[last] = inside[last]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offsets, s, side="right") - 1


def space_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs between ASCII white space."""
    return words(data, offsets, _SPACE)


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ASCII letters, digits and all non-ASCII characters."""
    return words(data, offsets, _NOT_WORD)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; equal runs have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lo, hi = int(starts[0]), int(ends[-1])
    n = hi - lo
    span = np.diff(np.append(starts, hi))
    position = np.arange(n) - np.repeat(starts - lo, span)
    length = ends - starts
    term = _CODE[data[lo:hi]] * _POWER[position & 1023]
    term[position >= np.repeat(length, span)] = 0
    return mix64(np.add.reduceat(term, starts - lo) + length.astype(np.uint64))


def count_space_words(column: pa.Array) -> pa.Array:
    """Words of each text between ASCII white space; 0 for a null."""
    data, offsets = string_buffers(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, j, part, own in slices(data, offsets):
        out[i:j] = np.bincount(space_words(part, own)[2], minlength=j - i)
    return pa.array(out)
