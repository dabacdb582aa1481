"""Structured Streaming extension: blocks deduplicated as they arrive, and windowed drift counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from paperloom.functions.text import MIN_BLOCK_WORDS, normalize, split_blocks, word_count


def arriving_blocks(docs: DataFrame, watermark: str = "1 day", delimiter: str = "\n\n") -> DataFrame:
    """Blocks of a stream (path, text, ts) of which no equal one arrived within the watermark.

    State is bounded by the watermark. The first to arrive stays; a batch run keeps the first by path.
    Short blocks always pass.
    """
    held = docs.select("path", "ts", F.explode(split_blocks(F.col("text"), delimiter)).alias("block")).withColumn("words", word_count(F.col("block")))
    keyed = held.withColumn("digest", F.when(F.col("words") >= MIN_BLOCK_WORDS, F.md5(normalize(F.col("block")))).otherwise(F.uuid()))
    return keyed.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["digest"]).select("path", "ts", "block", "words")


def change_windows(events: DataFrame, width: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """(start, event_type, events, users) of a stream (ts, event_type, user_id), late rows up to the watermark."""
    timed = events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "event_type")
    return timed.agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("start"), "event_type", "events", "users")


def ingest(stream: DataFrame, table_path: str, checkpoint: str, watermark: str = "1 day", delimiter: str = "\n\n") -> StreamingQuery:
    """Appends the arriving blocks to Parquet; runs what is there and ends."""
    out = arriving_blocks(stream, watermark, delimiter)
    return out.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

