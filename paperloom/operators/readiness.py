"""Readiness of chunks: noise, boundaries, depth, score, grade; summaries and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.structure import marks
from paperloom.functions.text import round_half_even_binary, split_blocks
from paperloom.session import shuffled

WEIGHTS = {"noise": 0.4, "boundary": 0.3, "context": 0.3}
GRADE_A, GRADE_B = 0.8, 0.5
MAX_SAMPLES, SAMPLE_CHARS = 5, 200


def noise_ratio(raw: Column, extracted: Column) -> Column:
    """The share of words that extraction took away, within 0 and 1; 0 without words."""
    return F.when(raw <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - extracted / raw)))


def context_depth(headings: Column, max_level: Column) -> Column:
    return F.when(headings > 0, max_level).otherwise(F.lit(0))


def context_score(depth: Column) -> Column:
    return F.when(depth >= 2, F.lit(1.0)).when(depth == 1, F.lit(0.5)).otherwise(F.lit(0.0))


def score(noise: Column, whole: Column, depth: Column) -> Column:
    boundary = F.when(whole, F.lit(1.0)).otherwise(F.lit(0.0))
    return (1.0 - noise) * WEIGHTS["noise"] + boundary * WEIGHTS["boundary"] + context_score(depth) * WEIGHTS["context"]


def grade(value: Column) -> Column:
    return F.when(value >= GRADE_A, "A").when(value >= GRADE_B, "B").otherwise("C")


def penalties(noise: Column, whole: Column, depth: Column) -> Column:
    """Array of (penalty, kind), in the order noise, boundary, context."""
    lost = {"noise": noise, "boundary": F.when(whole, F.lit(0.0)).otherwise(F.lit(1.0)), "context": 1.0 - context_score(depth)}
    return F.array(*(F.struct((v * WEIGHTS[k]).alias("penalty"), F.lit(k).alias("kind")) for k, v in lost.items()))


def dominant_penalty(of: Column) -> Column:
    """The kind of the largest penalty, the first of equals; ``none`` if all are 0."""
    top = F.array_max(F.transform(of, lambda p: p["penalty"]))
    first = F.get(F.filter(of, lambda p: p["penalty"] == top), 0)["kind"]
    return F.when(top > 0, first).otherwise("none")


def score_rows(rows: DataFrame) -> DataFrame:
    """``rows`` (raw_words, extracted_words, headings, max_level, whole) with noise, depth, score and grade."""
    out = rows.withColumn("noise_ratio", noise_ratio(F.col("raw_words"), F.col("extracted_words"))).withColumn("context_depth", context_depth(F.col("headings"), F.col("max_level")))
    out = out.withColumn("score", score(F.col("noise_ratio"), F.col("whole"), F.col("context_depth")))
    return out.withColumn("grade", grade(F.col("score")))


def score_chunks(members: DataFrame, pages: DataFrame) -> DataFrame:
    """Scores of chunks: members (path, chunk) over pages (path, raw_words, extracted_words, headings, max_level, fences, pre_open, pre_close).

    Boundaries of a chunk follow from the counts of its pages, so no text is joined together.
    """
    joined = members.select("path", "chunk").join(shuffled(pages), "path").groupBy("chunk").agg(
        F.sum("raw_words").alias("raw_words"), F.sum("extracted_words").alias("extracted_words"), F.sum("headings").alias("headings"),
        F.max("max_level").alias("max_level"), ((F.sum("fences") % 2 == 0) & (F.sum("pre_open") == F.sum("pre_close"))).alias("whole"),
    )
    return score_rows(joined)


def boundary_counts(text: Column) -> list[Column]:
    """Columns fences, pre_open, pre_close."""
    return [F.coalesce(n, F.lit(0)).cast("bigint").alias(name) for n, name in zip(marks(text), ("fences", "pre_open", "pre_close"), strict=True)]


def summary(scores: DataFrame) -> DataFrame:
    """One row: total_chunks, avg_score and the chunks of each grade."""
    return scores.agg(F.count("*").alias("total_chunks"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("avg_score"), *(F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABC"))


def artifact_columns(scores: DataFrame) -> DataFrame:
    """Scores to two decimals, noise to three, as artifacts show them."""
    return scores.withColumn("score", round_half_even_binary(F.col("score"), 2)).withColumn("noise_ratio", round_half_even_binary(F.col("noise_ratio"), 3))


def worst_first(scores: DataFrame) -> DataFrame:
    return scores.orderBy("score", "chunk")


def removed_samples(docs: DataFrame, raw: str, extracted: str, delimiter: str = "\n\n") -> DataFrame:
    """(path, pos, sample): blocks of ``raw`` that ``extracted`` lacks, as multisets; five a document at most.

    Of a block that stands n times in one and m in the other the first m are matched, so later copies surface.
    """
    side = lambda c: docs.select("path", F.posexplode(split_blocks(F.col(c), delimiter)).alias("pos", "block"))
    nth = F.row_number().over(Window.partitionBy("path", "block").orderBy("pos"))
    left = side(raw).withColumn("nth", nth)
    right = side(extracted).groupBy("path", "block").agg(F.count("*").alias("n"))
    gone = left.join(right, ["path", "block"], "left").where(F.col("nth") > F.coalesce("n", F.lit(0)))
    best = gone.groupBy("path").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "block"))), 1, MAX_SAMPLES).alias("s"))
    return best.select("path", F.explode("s").alias("s")).select("path", F.col("s.pos").cast("bigint").alias("pos"), F.substring("s.block", 1, SAMPLE_CHARS).alias("sample"))


def dry_run_totals(stats: DataFrame) -> DataFrame:
    """One row of sums and whole percentages over (before, after, deduped)."""
    out = stats.agg(F.count("*").alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("before", "after", "deduped")))
    share = lambda a, b: F.expr(f"CASE WHEN {a} > 0 THEN ({a} - {b}) * 100 div {a} ELSE 0 END").cast("bigint")
    return out.withColumn("extraction_percent", share("before", "after")).withColumn("dedup_percent", share("after", "deduped"))

