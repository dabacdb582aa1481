"""Bulk-synchronous best-fit packing of documents into sequences of a fixed capacity.

A document longer than the capacity is cut into full sequences and a rest. The pieces are packed in supersteps, by
size classes from large to small: (capacity/2, capacity], (capacity/4, capacity/2] and so on, the last from 1. The
open sequences with their gaps are a table. In a superstep

* the class's pieces and the gaps, cut into slots (a gap of several class bounds is several slots), are range-sorted together by
  size, larger first, and swept: each piece, from large to small, takes the least slot that holds it, its
  successor. On a sorted run that is the matching of brackets, slots opening and pieces closing: every partition
  matches its own, in one pass, and what stays open on either side is matched between partitions
  as intervals of ranks, composed from two numbers of each partition;
* where pieces compete for a slot, rank decides: larger first, then by (doc_id, piece);
* the gaps shrink by what they got, and the sweep is repeated with the pieces left. When it places none, new
  sequences are opened for the first of the pieces left, one for each ``capacity // class bound`` of them, in the last
  class as many as their tokens fill.

Every state is a written table; the driver sees a few numbers for each partition of a sweep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.mixing import token_count
from paperloom.session import written

CAPACITY = 2048
#: The class of the smallest pieces reaches from 1 to this size or to the first halving under its double.
LEAST_CLASS = 16
#: Pieces and slots in a partition of a sweep, about.
PARTITION_ROWS = 1 << 17
_PIECE = ["doc_id", "piece", "start", "tokens"]


def pieces(items: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, start, tokens) of every document with tokens, cut at the capacity."""
    count = F.expr(f"cast((tokens - 1) div {capacity} as int)")
    cut = items.where("tokens > 0").select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), count)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - start).alias("tokens"))


def matched(is_piece: np.ndarray) -> np.ndarray:
    """For each row of a sorted run the place of the row it is matched with, or -1.

    Slots open and pieces close brackets: a piece meets the last slot before it that is still open.
    """
    step = np.where(is_piece, -1, 1)
    level = np.cumsum(step)
    lowest = np.minimum(0, np.minimum.accumulate(level))
    before = np.append(0, lowest[:-1])
    alone = is_piece & (level < before)  # no slot is open: the run's level falls to a new low
    depth = level - lowest + is_piece  # of a pair, the level that its slot opens
    rows = np.flatnonzero(~alone)
    order = rows[np.lexsort((rows, depth[rows]))]
    out = np.full(len(is_piece), -1, np.int64)
    pair = np.flatnonzero(~is_piece[order[:-1]] & is_piece[order[1:]] & (depth[order[:-1]] == depth[order[1:]])) if len(order) > 1 else np.zeros(0, np.int64)
    out[order[pair]], out[order[pair + 1]] = order[pair + 1], order[pair]
    return out


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches a partition's run; rows left alone get their rank among the partition's pieces, or slots, left alone."""
    from pyspark import TaskContext

    held = list(batches)
    if not held:
        return
    run = pa.Table.from_batches(held).combine_chunks()
    is_piece = run.column("is_piece").to_numpy().astype(bool)
    other = matched(is_piece)
    seq = run.column("seq").fill_null(-1).to_numpy()
    keep = is_piece | (other < 0)
    alone = other < 0
    rank = np.where(is_piece, np.cumsum(is_piece & alone), np.cumsum(~is_piece & alone)) - 1
    got = np.where(is_piece & ~alone, seq[np.maximum(other, 0)], seq)
    cols = {"part": np.full(len(seq), TaskContext.get().partitionId()), "rank": np.where(alone, rank, -1), "seq": got}
    out = run.select(["is_piece", *_PIECE])
    for name, values in cols.items():
        nulls = is_piece & alone if name == "seq" else None
        out = out.append_column(name, pa.array(values.astype(np.int64), mask=nulls))
    yield from out.filter(pa.array(keep)).to_batches()


def between(counts: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """Matches what partitions left alone, from (partition, pieces, slots) in order of size.

    Gives (partition of the pieces, first rank, how many, partition of the slots, first slot rank), the slots taken
    from the last, the least, on, and how many pieces of each partition are matched. A partition's pieces
    are matched from the first on.
    """
    stack: list[list[int]] = []
    moves, done = [], {}
    for part, n_pieces, n_slots in sorted(counts):
        at = 0
        while at < n_pieces and stack:
            n = min(n_pieces - at, stack[-1][1])
            moves.append((part, at, n, stack[-1][0], stack[-1][1] - 1))
            stack[-1][1] -= n
            at += n
            if not stack[-1][1]:
                stack.pop()
        done[part] = at
        if n_slots:
            stack.append([part, n_slots])
    return moves, done


def _local(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table that the plan holds itself."""
    columns = np.array(rows, np.int64).reshape(-1, len(names)).T
    return spark.createDataFrame(pa.table({n: pa.array(c) for n, c in zip(names, columns, strict=True)}))


def sweep(left: DataFrame, slots: DataFrame | None, rows: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(pieces that got a sequence, pieces left with their rank, how many are left) of one superstep."""
    spark = left.sparkSession
    shape = [F.lit(True).alias("is_piece"), *_PIECE, F.lit(None).cast("bigint").alias("seq"), F.col("tokens").alias("size")]
    both = left.select(*shape)
    if slots is not None:
        empty = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in _PIECE]
        both = both.unionByName(slots.select(F.lit(False).alias("is_piece"), *empty, "seq", "size"))
    order = [F.desc("size"), "is_piece", "doc_id", "piece", "seq"]
    ran = both.repartitionByRange(max(1, -(-rows // PARTITION_ROWS)), *order).sortWithinPartitions(*order)
    kind = T.StructType([*(ran.schema[c] for c in ("is_piece", *_PIECE)), *(T.StructField(c, T.LongType()) for c in ("part", "rank", "seq"))])
    ran = written(ran.mapInArrow(_sweep, kind), "pack-sweep")
    alone = ran.where("rank >= 0")
    counts = [(r["part"], r["pieces"], r["slots"]) for r in alone.groupBy("part").agg(F.count_if("is_piece").alias("pieces"), F.count_if(~F.col("is_piece")).alias("slots")).collect()]  # a row for each partition
    moves, done = between(counts)
    got = ran.where("is_piece and rank < 0").select(*_PIECE, "seq")
    if moves:
        table = F.broadcast(_local(spark, moves, ["m_part", "m_rank", "n", "s_part", "s_rank"]))  # two rows for each partition at most
        lone = alone.where("is_piece").join(table, (F.col("part") == F.col("m_part")) & (F.col("rank") >= F.col("m_rank")) & (F.col("rank") < F.col("m_rank") + F.col("n")))
        lone = lone.select(*_PIECE, "s_part", (F.col("s_rank") - (F.col("rank") - F.col("m_rank"))).alias("at"))
        free = alone.where("not is_piece").select(F.col("part").alias("s_part"), F.col("rank").alias("at"), "seq")
        got = written(got.unionByName(lone.join(free, ["s_part", "at"]).select(*_PIECE, "seq")), "pack-got")
    offset, total = {}, 0
    for part, n, _ in sorted(counts):
        offset[part] = (done[part], total)
        total += n - done[part]
    if not total:
        return got, None, 0
    starts = F.broadcast(_local(spark, [(p, d, o) for p, (d, o) in offset.items()], ["o_part", "done", "o"]))  # a row for each partition
    rest = alone.where("is_piece").join(starts, F.col("part") == F.col("o_part")).where("rank >= done")
    return got, rest.select(*_PIECE, (F.col("rank") - F.col("done") + F.col("o")).alias("nth")), total


def slots_of(gaps: DataFrame, low: int, high: int, each: Column | int) -> DataFrame:
    """(seq, size): the gaps that can hold a piece of the class (low, high], cut into at most ``each`` slots."""
    many = F.greatest(F.lit(1), F.least(F.expr(f"gap div {high}"), F.lit(each).cast("bigint")))
    cut = gaps.where(F.col("gap") > low).select("seq", "gap", many.alias("many")).withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("many"))))
    return cut.select("seq", F.when(F.col("k") < F.col("many"), F.lit(high)).otherwise(F.col("gap") - (F.col("many") - 1) * high).cast("bigint").alias("size"))


def place_pieces(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, tokens, seq_id): each piece and its sequence.

    ``items`` has (doc_id, tokens). Equal rows are pieces of their own, a null doc_id comes first, and
    items whose tokens are null or not above 0 are left out.
    """
    spark = items.sparkSession
    cut = written(pieces(items, capacity), "pack-pieces")
    kind = T.StructType([*cut.schema.fields, T.StructField("seq", T.LongType())])
    sizes = dict(cut.groupBy("tokens").count().collect())  # a row for each size at most
    placed: list[DataFrame] = []
    gaps, opened, fits = None, 0, {}
    tops = [b for k in range(capacity.bit_length()) if (b := capacity >> k) >= LEAST_CLASS] or [capacity]
    bounds = [(low, top) for top, low in zip(tops, [*tops[1:], 0], strict=True)]
    for low, high in bounds:
        left = cut.where(F.col("tokens").between(low + 1, high))
        n_left = sum(n for size, n in sizes.items() if low < size <= high)
        while n_left:
            small, large, cells = fits.get(low, (0, 0, 0))
            each = capacity // high
            if cells > 4 * n_left:  # many more slots than pieces can't be needed at once
                each = -(-2 * n_left // large)
            slots = slots_of(gaps, low, high, each) if small + large else None
            got, rest, n_rest = sweep(left, slots, n_left + small + min(cells, large * each))
            placed.append(got)
            fresh = None
            if n_rest == n_left:
                new = -(-n_rest // (capacity // high)) if low else -(-rest.agg(F.sum("tokens")).first()[0] // capacity)
                fresh = rest.where(F.col("nth") < new).select(*_PIECE, (F.col("nth") + opened).alias("seq"))
                placed.append(fresh)
                rest, n_rest, opened = rest.where(F.col("nth") >= new), n_rest - new, opened + new
            filled = got.groupBy(F.col("seq").alias("own")).agg(F.sum("tokens").alias("filled"))
            after = gaps.join(filled, F.col("seq") == F.col("own"), "left").select("seq", (F.col("gap") - F.coalesce("filled", F.lit(0))).alias("gap")) if gaps is not None else None
            if fresh is not None:
                begun = fresh.select("seq", (F.lit(capacity) - F.col("tokens")).alias("gap"))
                after = after.unionByName(begun) if after is not None else begun
            if after is not None:
                seen = Observation()  # for each class the gaps under its bound, those at or above it, and the slots of these, counted as they are written
                gap = F.col("gap")
                counts = [c for b, top in bounds for c in (F.count_if((gap > b) & (gap < top)).alias(f"small_{b}"), F.count_if(gap >= top).alias(f"large_{b}"), F.coalesce(F.sum(F.expr(f"gap div {top}")), F.lit(0)).alias(f"cells_{b}"))]
                gaps = written(after.where("gap > 0").observe(seen, *counts), "pack-gaps")
                fits = {b: tuple(seen.get[f"{c}_{b}"] for c in ("small", "large", "cells")) for b, _ in bounds}
            left, n_left = rest.select(*_PIECE) if n_rest else None, n_rest
    out = spark.createDataFrame([], kind)
    for got in placed:
        out = out.unionByName(got)
    return out.withColumnRenamed("seq", "seq_id")


def sequences(placed: DataFrame) -> DataFrame:
    """(seq_id, tokens, doc_ids, starts, lengths): one row for each sequence, its pieces from large to small, then by doc_id and start."""
    rows = placed.groupBy("seq_id").agg(F.sum("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct((-F.col("tokens")).alias("less"), "doc_id", "start", "tokens"))).alias("p"))
    return rows.select("seq_id", "tokens", F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.tokens").alias("lengths"))


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences that hold all tokens of ``docs``; see :func:`sequences`.

    Texts that are null, empty or only white space have no tokens and are in no sequence; very long ones are cut
    into as many sequences as they need. Repeated rows are packed as often as they are there, ties go by doc_id and piece.
    Other columns, whatever their names, are not looked at. No rows give no rows.
    """
    return sequences(place_pieces(docs.select(F.col(id_col).alias("doc_id"), token_count(F.col(text_col)).alias("tokens")), capacity))
