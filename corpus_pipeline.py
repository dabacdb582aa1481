"""The corpus pipeline: classify, dedup lines, drop near duplicates, mix sources, pack sequences.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents`` and any further columns
that ``docs`` has, whatever their names; the last returns one row for each packed sequence. No stage fails on nulls
in any column, empty or very long texts, ties, repeated rows or an empty table; what it makes of them stands below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import linededup, mixing, packing, puquality, simhash
from paperloom.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier keeps.

    Null, empty and white-space texts go; rows with a null id or label, and repeated rows, are judged by their text, each
    for itself. Where the labels name no two positives, or no two documents are unlabelled, all rows stay.
    """
    return puquality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stood before; ``n_chars`` follows the text.

    Documents of even id, and those without one, are the index's first batch; those of odd id are its second and probe the
    filters of the first. Within a batch a line stays in the document of least id. A null text stays null with a null ``n_chars``; an
    empty text stays; a document that lost all but white space goes, as does a row whose id and text another row has.
    """
    even = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))
    return linededup.dedup_lines(docs, batches=[even, ~even]).withColumn("n_chars", F.length("text").cast("bigint"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of least id, nulls first.

    Documents whose text is null or holds no word all stay; rows that repeat the id and text of the one kept stay with it.
    """
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to shares by the square root of their tokens, repeated or sampled by quality weight.

    A null source is a source; rows of one id are taken together and in as many copies as they are there. Documents without tokens
    come with the complete epochs of their source, and with its fraction if their key is drawn.
    """
    return mixing.mix_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most ``packing.CAPACITY`` tokens.

    Texts without tokens are in no sequence; a text longer than a sequence is cut; repeated rows are packed as often as they are there.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: The first stage is a trained network, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each but the last written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
