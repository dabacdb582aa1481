"""Token counts by a pluggable tokenizer; the default counts words and needs no vocabulary."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import word_count

ENCODINGS = {"cl100k": "cl100k_base", "o200k": "o200k_base", "p50k": "p50k_base"}


def encoding_name(name: str) -> str:
    """The full name of an encoding or its alias."""
    full = ENCODINGS.get(name, name)
    if full not in ENCODINGS.values():
        raise ValueError(f"unknown encoding {name!r}")
    return full


def token_count(text: Column, make: Callable[[], Callable[[str], int]] | None = None) -> Column:
    """Tokens of each text; ``make`` is called once in each worker and returns the counting function."""
    if make is None:
        return word_count(text)
    held: list = []

    def run(column: pa.Array) -> pa.Array:
        if not held:
            held.append(make())
        return pa.array([0 if t is None else held[0](t) for t in column.to_pylist()], pa.int64())

    return F.arrow_udf(run, "bigint")(text)


def tiktoken_counter(encoding: str) -> Callable[[], Callable[[str], int]]:
    """A counter that loads the encoding's vocabulary, which must be cached where there is no network."""
    name = encoding_name(encoding)

    def make() -> Callable[[str], int]:
        import tiktoken

        own = tiktoken.get_encoding(name)
        return lambda t: len(own.encode(t, disallowed_special=()))

    return make


def file_counter(path: str) -> Callable[[], Callable[[str], int]]:
    """A counter by a vocabulary file that every worker can read: ``.json`` of tokenizers or ``.model`` of sentencepiece."""
    if not path.endswith((".json", ".model")):
        raise ValueError(f"unknown kind of vocabulary {path!r}")

    def make() -> Callable[[str], int]:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            return lambda t: len(own.encode(t, add_special_tokens=False).ids)
        from sentencepiece import SentencePieceProcessor

        piece = SentencePieceProcessor(model_file=path)
        return lambda t: len(piece.encode(t))

    return make


def totals(counts: DataFrame) -> DataFrame:
    """One row: chunks, total, average (whole), least and most of the column ``tokens``."""
    out = counts.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("total"), F.min("tokens").alias("least"), F.max("tokens").alias("most"))
    return out.withColumn("average", F.expr("CASE WHEN chunks > 0 THEN total div chunks END"))
