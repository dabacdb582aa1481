"""Text expressions: words and blocks as Arrow functions, tokens, excerpts and paths inside Catalyst.

Python's own split and strip part words by the class below; a regular expression of it takes twenty times as long on the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of the white-space class by which words are separated, as Java and RE2 both read them.
_MEMBERS = r"\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS, NOT_WS = f"[{_MEMBERS}]", f"[^{_MEMBERS}]"
MIN_BLOCK_WORDS = 10


def _each(column: pa.Array, of: Callable[[str], object], kind: pa.DataType, null: object = None) -> pa.Array:
    parts = (column.slice(i, 256).to_pylist() for i in range(0, len(column), 256))  # not all texts of a batch at a time
    return pa.array((null if t is None else of(t) for part in parts for t in part), kind)


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null."""
    return F.arrow_udf(lambda c: _each(c, lambda t: len(t.split()), pa.int64(), 0), "bigint")(text)


def line_words(text: Column) -> Column:
    """Words of each line that has any, in order; an empty array for a null."""
    return F.arrow_udf(lambda c: _each(c, lambda t: [len(w) for w in map(str.split, t.split("\n")) if w], pa.list_(pa.int64()), []), "array<bigint>")(text)


def normalize(text: Column) -> Column:
    """Lower case, runs of white space made one space, outer ones dropped."""
    return F.arrow_udf(lambda c: _each(c, lambda t: " ".join(t.split()), pa.string()), "string")(F.lower(text))


def split_blocks(text: Column, delimiter: str = "\n\n") -> Column:
    """Stripped blocks that aren't empty, in order."""
    return F.arrow_udf(lambda c: _each(c, lambda t: [b for b in map(str.strip, t.split(delimiter)) if b], pa.list_(pa.string())), "array<string>")(text)


def long_blocks(text: Column, delimiter: str = "\n\n") -> Column:
    """Array of (pos, norm, words): the blocks of at least ``MIN_BLOCK_WORDS`` words, normalised, with their places among all blocks."""

    def of(t: str) -> list[dict]:
        own = enumerate(w for w in map(str.split, t.split(delimiter)) if w)
        return [{"pos": i, "norm": " ".join(w), "words": len(w)} for i, w in own if len(w) >= MIN_BLOCK_WORDS]

    kind = pa.list_(pa.struct([("pos", pa.int32()), ("norm", pa.string()), ("words", pa.int64())]))
    return F.arrow_udf(lambda c: _each(c, of, kind), "array<struct<pos:int,norm:string,words:bigint>>")(F.lower(text))


def tokenize(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case; any other character separates."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def excerpt(text: Column, words: int = 50) -> Column:
    """The text as it is if it is short, else its first words and an ellipsis in brackets."""
    cut = F.slice(F.regexp_extract_all(text, F.lit(NOT_WS + "+"), 0), 1, words)
    return F.when(word_count(text) <= words, text).otherwise(F.concat(F.array_join(cut, " "), F.lit(" […]")))


def truncate_path(path: Column, length: int = 40) -> Column:
    """The path, or an ellipsis and its end."""
    return F.when(F.length(path) > length, F.concat(F.lit("..."), F.right(path, F.lit(length - 3)))).otherwise(path)


def parent_dir(path: Column) -> Column:
    """What is before the last slash; an underscore for the root."""
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(d == "", F.lit("_")).otherwise(d)


def is_html(path: Column) -> Column:
    return path.rlike(r"(?i)\.html?$")


def round_half_even_binary(value: Column, digits: int) -> Column:
    """Rounding of the exact binary value, ties to even: what artifacts of two or three decimals show."""

    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else round(x, digits) for x in v.to_pylist()], pa.float64())

    return F.arrow_udf(run, "double")(value)


def blocks(docs: DataFrame, delimiter: str = "\n\n") -> DataFrame:
    """(path, pos, block) of ``docs`` (path, text); a null text has no block."""
    return docs.select("path", F.posexplode(split_blocks(F.col("text"), delimiter)).alias("pos", "block"))
