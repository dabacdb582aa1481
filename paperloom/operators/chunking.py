"""Ordered packing of files into chunks, in parallel although each choice hangs on those before it.

Next-fit is a fold. A run of consecutive files (a block) maps the state at its start to the state at
its end, and that map is a short step function: the state only decides where the first new chunk
starts in the block, and from there on all is fixed. So every block computes its step function in
parallel, the driver composes them (a few numbers for each block), and a second parallel pass numbers
the chunks. The state is the words in the open chunk, or -1 if none is open.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import parent_dir
from paperloom.session import new_folder, shuffled, written

#: Rows of (order, words) in a block, about.
BLOCK_ROWS = 200_000
_STEP = "block int, total long, below array<long>, exits array<long>, counts array<long>"


def _in_blocks(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """``df`` in total order, written once, with the number of its block (``_block``).

    What ``df`` is made of is worked off once and in the partitions that it has: counting, sampling for the ranges and the
    few blocks come after its rows are written.
    """
    df = written(df, f"{label}-rows")
    parts = max(1, -(-df.count() // BLOCK_ROWS))
    ranged = df.repartitionByRange(parts, *order) if parts > 1 else df.coalesce(1)
    return written(ranged.withColumn("_block", F.spark_partition_id()), label)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its place in the total order, from 1: ranks in a block plus the sizes of earlier blocks."""
    cut = _in_blocks(df, order, "numbered")
    sizes = {r["_block"]: r["count"] for r in cut.groupBy("_block").count().collect()}  # one row for each block
    before, at = {}, 0
    for block in sorted(sizes):
        before[block], at = at, at + sizes[block]
    schema = cut.drop("_block").schema.add(name, "long")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable", na_position="first").drop(columns="_block")
        rows[name] = before[key[0]] + 1 + np.arange(len(rows))
        return rows

    return cut.groupBy("_block").applyInPandas(run, schema)


def _starts(words: np.ndarray, reset: np.ndarray, limit: int) -> np.ndarray:
    """For each place the next place at which a chunk starts if one starts here; n for none."""
    n = len(words)
    total = np.cumsum(words)
    nxt = np.searchsorted(total, total - words + limit, side="right")
    nxt = np.where(words > limit, np.arange(n) + 1, nxt)
    forced = np.append(np.flatnonzero(reset), n)
    return np.minimum(nxt, forced[np.searchsorted(forced, np.arange(n), side="right")])


def _step_function(words: np.ndarray, weight: np.ndarray, reset: np.ndarray, limit: int) -> tuple[int, list[int], list[int], list[int]]:
    """(total, below, exits, counts): entering with ``below[i]`` or more words (in descending order)
    ends in ``exits[i]`` after ``counts[i]`` chunk numbers; with fewer than all, nothing starts."""
    n, total = len(words), np.cumsum(words)
    nxt = _starts(words, reset, limit)
    exits = np.where(words > limit, -1, total[-1] - total + words)
    count, jump = weight.copy(), nxt.copy()
    while (jump < n).any():
        live = np.flatnonzero(jump < n)
        to = jump[live]
        exits[live], extra, after = exits[to], count[to], jump[to]
        count[live] += extra
        jump[live] = after
    forced = np.flatnonzero(reset)
    last = min(n - 1, int(np.searchsorted(total, limit, side="right")), int(forced[0]) if len(forced) else n)
    need = limit - total[: last + 1] + 1
    if len(forced) and forced[0] == last:
        need[last] = 0
    keep = np.append(True, need[1:] < need[:-1])  # an earlier place of the same need comes first
    return int(total[-1]), need[keep].tolist(), exits[: last + 1][keep].tolist(), count[: last + 1][keep].tolist()


def _enter(state: int, row) -> tuple[int, int]:
    """(state, chunk numbers) after a block."""
    if state < 0:
        return row["exits"][0], row["counts"][0]
    i = bisect.bisect_left([-b for b in row["below"]], -state)
    if i < len(row["below"]):
        return row["exits"][i], row["counts"][i]
    return state + row["total"], 0


def fold_chunks(items: DataFrame, order: list[str], limit: int) -> DataFrame:
    """``items`` with ``chunk``: the chunk number of each row in the total order.

    ``items`` has (words, weight, reset) besides. A row with ``reset`` starts a chunk in any case; a row
    that starts one raises the number by its weight.
    """
    cut = _in_blocks(items, order, "chunk-items")

    def arrays(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        rows = rows.sort_values(order, kind="stable", na_position="first")
        return rows, rows["words"].to_numpy(np.int64), rows["weight"].to_numpy(np.int64), rows["reset"].to_numpy(bool)

    def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, words, weight, reset = arrays(rows)
        total, below, exits, counts = _step_function(words, weight, reset, limit)
        return pd.DataFrame({"block": [key[0]], "total": [total], "below": [below], "exits": [exits], "counts": [counts]})

    entry, state, number = {}, -1, 0
    steps = cut.groupBy("_block").applyInPandas(step, _STEP).orderBy("block")
    for row in steps.toLocalIterator():  # one row for each BLOCK_ROWS rows
        entry[row["block"]] = (state, number)
        state, more = _enter(state, row)
        number += more
    schema = cut.drop("_block").schema.add("chunk", "long")

    def number_rows(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, words, weight, reset = arrays(rows)
        state, at = entry[key[0]]
        nxt, total = _starts(words, reset, limit), np.cumsum(words)
        forced = np.flatnonzero(reset)
        first = 0 if state < 0 else min(int(np.searchsorted(total, limit - state, side="right")), int(forced[0]) if len(forced) else len(words))
        starts = np.zeros(len(words), np.int64)
        while first < len(words):
            starts[first] = weight[first]
            first = int(nxt[first])
        rows = rows.drop(columns="_block")
        rows["chunk"] = at + np.cumsum(starts)
        return rows

    return cut.groupBy("_block").applyInPandas(number_rows, schema)


def chunk_by_size(files: DataFrame, max_words: int, order: list[str] | None = None) -> DataFrame:
    """(path, words, chunk) of files (path, words): next-fit; a file over the limit has its own chunk."""
    own = files.select(*dict.fromkeys([*(order or []), "path", "words"])).withColumns({"weight": F.lit(1), "reset": F.lit(False)})
    return fold_chunks(own, order or ["path"], max_words).select("path", "words", "chunk")


def chunk_by_directory(files: DataFrame, max_words: int) -> DataFrame:
    """(path, words, chunk): directories stay whole; one over the limit is split by next-fit alone."""
    own = files.select("path", "words", parent_dir(F.col("path")).alias("dir"))
    groups = own.groupBy("dir").agg(F.sum("words").alias("words"), F.min("path").alias("first"))
    large = groups.where(F.col("words") > max_words).select("dir", "first")
    inner = own.join(shuffled(large), "dir").select("dir", "path", "words", F.lit(1).alias("weight"), (F.col("path") == F.col("first")).alias("reset"))
    inner = written(fold_chunks(inner, ["dir", "path"], max_words), "chunk-inner")
    spans = inner.groupBy("dir").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    sized = groups.join(shuffled(spans), "dir", "left").select("dir", "words", F.coalesce(F.col("high") - F.col("low") + 1, F.lit(1)).alias("weight"), F.lit(False).alias("reset"))
    outer = fold_chunks(sized, ["dir"], max_words).select("dir", "weight", "chunk")
    base = outer.join(shuffled(spans), "dir").select("dir", (F.col("chunk") - F.col("weight") + 1 - F.col("low")).alias("shift"))
    split = inner.select("dir", "path", "words", "chunk").join(shuffled(base), "dir").select("path", "words", (F.col("chunk") + F.col("shift")).alias("chunk"))
    whole = own.join(shuffled(outer.select("dir", "chunk")), "dir").join(shuffled(spans.select("dir")), "dir", "left_anti").select("path", "words", "chunk")
    return whole.unionByName(split)


def balance(members: DataFrame, target: int, max_words: int) -> DataFrame:
    """(path, words, chunk): at most ``target`` chunks of about equal words; the last takes what is left.

    ``members`` has (path, words, chunk); files keep the order (chunk, path). The driver looks at one
    block around each of the ``target`` ends, never at all files.
    """
    named = numbered(members.select("path", "words", "chunk"), ["chunk", "path"], "pos").drop("chunk")
    cut = _in_blocks(named, ["pos"], "balance-items")
    path = new_folder(cut.sparkSession, "balance-blocks")
    cut.write.partitionBy("_block").parquet(path)  # so that one block is read from its own folder
    by_block = cut.sparkSession.read.schema(cut.schema).parquet(path)
    summary = cut.groupBy("_block").agg(F.sum("words").alias("words"), F.count("*").alias("n"), F.min("pos").alias("first")).orderBy("first").collect()  # a row for each block
    n, total = sum(r["n"] for r in summary), sum(r["words"] for r in summary)
    if n <= target:
        return named.select("path", "words", F.col("pos").alias("chunk"))
    goal, run = total // target, np.cumsum([0, *(r["words"] for r in summary)])
    held: dict[int, np.ndarray] = {}

    def sums(b: int) -> np.ndarray:
        """Running sums of the words of one block, read from its own folder."""
        if b not in held:
            held.clear()
            rows = by_block.where(F.col("_block") == summary[b]["_block"]).select("pos", "words").toPandas().sort_values("pos")
            held[b] = run[b] + np.cumsum(rows["words"].to_numpy())
        return held[b]

    def first_at(least: int) -> int:
        """The first place, from 0, whose running sum is at least ``least``."""
        b = int(np.searchsorted(run[1:], least, side="left"))
        return n if b >= len(summary) else summary[b]["first"] - 1 + int(np.searchsorted(sums(b), least, side="left"))

    def running(at: int) -> int:
        """Words of the first ``at`` files."""
        if at == 0:
            return 0
        b = int(np.searchsorted([r["first"] for r in summary], at, side="right")) - 1
        return int(sums(b)[at - summary[b]["first"]])

    bounds, at = [0], 0
    while len(bounds) < target:
        base = running(at)
        full = max(at + 1, first_at(base + goal) + 1)
        over = max(at + 1, first_at(base + max_words + 1))
        at = min(full, over)
        if at >= n:
            break
        bounds.append(at)
    marks = F.array(*(F.lit(b + 1).cast("bigint") for b in bounds))
    chunk = F.size(F.filter(marks, lambda m: m <= F.col("pos"))).cast("bigint")
    return named.select("path", "words", chunk.alias("chunk"))


def chunk_totals(members: DataFrame) -> DataFrame:
    """(chunk, files, words)."""
    return members.groupBy("chunk").agg(F.count("*").alias("files"), F.sum("words").alias("words"))


def chunk_id(chunk, prefix: str = "docs_chunk_"):
    """``prefix`` and the number, two digits at least."""
    return F.format_string(f"{prefix}%02d", chunk)
