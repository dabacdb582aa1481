"""Statistics of whole texts that the quality operators learn from, one Arrow pass for all of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.llm import scan

NAMES = ("words", "word_bytes", "upper_share", "digit_share", "symbol_share", "stop_share", "comma_share", "repeat_share", "trigram_repeats", "distinct_share", "lines_per_word")
SCHEMA = ", ".join(f"{n} double" for n in NAMES)

_OTHER, _UPPER, _DIGIT, _SYMBOL, _STOP, _COMMA, _LINE, _SPACE = range(8)
_KIND = np.zeros(256, np.int64)
for _chars, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT), (b"!#$%&*+/<=>?@[\\]^_`{|}~\"()-:;", _SYMBOL), (b".", _STOP), (b",", _COMMA), (b"\n", _LINE), (b" \t\r\x0b\x0c", _SPACE)):
    _KIND[list(_chars)] = _kind


def _per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row[values], minlength=n) if values.dtype == bool else np.bincount(row, weights=values, minlength=n)


def _distinct(row: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each row, known by 44 bits within the row."""
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    return np.bincount((key[first] >> np.uint64(44)).astype(np.int64), minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of NAMES for each text; all zero for a text that is null or has no word.

    Shares are of bytes other than white space, ``repeat_share`` is the share of words equal to the
    word before, ``trigram_repeats`` that of word trigrams that stood in the text before, and
    ``distinct_share`` that of distinct words.
    """
    data, offsets = scan.string_buffers(column)
    out = np.zeros((len(offsets) - 1, len(NAMES)))
    for i, j, part, own in scan.slices(data, offsets):
        n = j - i
        start, end, row = scan.space_words(part, own)
        if not len(row):
            continue
        owner = np.repeat(np.arange(n), np.diff(own))
        kinds = np.bincount(owner * 8 + _KIND[part], minlength=n * 8).reshape(n, 8).astype(float)
        words = np.bincount(row, minlength=n).astype(float)
        black = np.maximum(1, kinds.sum(1) - kinds[:, _LINE] - kinds[:, _SPACE])
        least = np.maximum(1, words)
        h = scan.word_hashes(part, start, end)
        second = np.append(False, row[1:] == row[:-1])
        again = np.append(False, h[1:] == h[:-1]) & second
        third = np.append([False, False], row[2:] == row[:-2])[: len(row)]
        at = np.flatnonzero(third)
        tri = scan.mix64(h[at] + np.uint64(3) * h[at - 1] + np.uint64(7) * h[at - 2])
        trigrams = np.maximum(0, words - 2)
        out[i:j] = np.stack([
            words, black / least, kinds[:, _UPPER] / black, kinds[:, _DIGIT] / black, kinds[:, _SYMBOL] / black, kinds[:, _STOP] / black, kinds[:, _COMMA] / black,
            _per_row(again, row, n) / least, (trigrams - _distinct(row[at], tri, n)) / np.maximum(1, trigrams), _distinct(row, h, n) / least, kinds[:, _LINE] / least,
        ], 1) * (words > 0)[:, None]
    return out


def _stats(text: pa.Array) -> pa.Array:
    rows = statistics(text)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(NAMES))], names=list(NAMES))


def text_stats(text: Column) -> Column:
    """A struct of NAMES."""
    return F.arrow_udf(_stats, SCHEMA)(text)
