"""Removal of repeated blocks over a corpus: exact by digest, fuzzy by SimHash leaders.

Blocks are ordered by (path, pos). Exact: of blocks with one digest the first stays. Fuzzy: a block
goes if an earlier block *that stays* is within the threshold; so the survivors are the
lexicographically first maximal independent set of the similarity graph, not its components.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import long_blocks, split_blocks
from paperloom.session import discard, shuffled, written

FINGERPRINT_BITS = 64


_ROTATE = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4, np.uint32)
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint64).astype(np.uint32)
_SLICE = 1 << 14


def md5_halves(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(N, 8): the first eight bytes of the MD5 digest of each run of bytes.

    Runs of under 56 bytes, one MD5 block each, are worked off together, longer ones one by one.
    """
    size = end - start
    out = np.empty((len(start), 8), np.uint8)
    for k in np.flatnonzero(size > 55):
        out[k] = np.frombuffer(hashlib.md5(data[start[k] : end[k]].tobytes()).digest()[:8], np.uint8)
    short = np.flatnonzero(size <= 55)
    padded = np.append(data, np.zeros(64, np.uint8))
    for i in range(0, len(short), _SLICE):
        own = short[i : i + _SLICE]
        n = size[own]
        block = padded[start[own][:, None] + np.arange(64)] * (np.arange(64) < n[:, None])
        block[np.arange(len(own)), n] = 0x80
        words = np.ascontiguousarray(block).view("<u4").T.copy()
        words[14] = n * 8
        a, b, c, d = (np.full(len(own), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        for r in range(64):
            if r < 16:
                f, g = d ^ (b & (c ^ d)), r
            elif r < 32:
                f, g = c ^ (d & (b ^ c)), (5 * r + 1) % 16
            elif r < 48:
                f, g = b ^ c ^ d, (3 * r + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * r % 16
            f = f + a + _SINES[r] + words[g]
            a, d, c, b = d, c, b, b + ((f << _ROTATE[r]) | (f >> (32 - _ROTATE[r])))
        out[own] = np.stack([a + np.uint32(0x67452301), b + np.uint32(0xEFCDAB89)], 1).astype("<u4").view(np.uint8)
    return out


def _simhash(column: pa.Array) -> pa.Array:
    """Normalised texts have single spaces, so a shingle is the bytes from one word's start to the end of the word after next."""
    column = column.fill_null("").cast(pa.large_string())
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    out, i = np.zeros(len(column), np.int64), 0
    while i < len(column):  # runs of texts of a few megabytes
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 22), side="right")) - 1)
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        space = np.flatnonzero(part == 32)
        begin, stop = np.sort(np.concatenate([own[:-1], space + 1])), np.sort(np.concatenate([space, own[1:]]))
        row = np.repeat(np.arange(j - i), np.bincount(np.searchsorted(own, space, side="right") - 1, minlength=j - i) + 1)
        full = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
        count = np.bincount(row[full], minlength=j - i)
        bits = np.unpackbits(md5_halves(part, begin[full], stop[full + 2]), axis=1)
        votes = np.zeros((j - i, FINGERPRINT_BITS), np.int64)
        some = np.flatnonzero(count)
        if len(some):
            votes[some] = np.add.reduceat(bits, np.searchsorted(row[full], some), axis=0, dtype=np.int64)
        prints = np.packbits(2 * votes > count[:, None], axis=1)
        few = np.flatnonzero(count == 0)
        prints[few] = md5_halves(part, own[few], own[few + 1])
        out[i:j] = prints.view(">i8")[:, 0]
        i = j
    return pa.array(out)


def simhash(normal: Column) -> Column:
    """64 bits of the votes of three-word shingles of a normalised text."""
    return F.arrow_udf(_simhash, "bigint")(normal)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def eligible(docs: DataFrame, delimiter: str = "\n\n") -> DataFrame:
    """(path, pos, norm, words) of blocks that are long enough to be compared."""
    return docs.select("path", F.explode(long_blocks(F.col("text"), delimiter)).alias("b")).select("path", "b.pos", "b.norm", "b.words")


def exact_removed(eligible_blocks: DataFrame) -> DataFrame:
    """(path, pos, words) of blocks whose digest stood before.

    First places come from a partial aggregation, so a block that stands in every document is no hot
    window partition; only digests that repeat are joined back. The digests are written once.
    """
    keyed = written(eligible_blocks.select("path", "pos", "words", F.md5("norm").alias("digest")), "block-digests")
    first = keyed.groupBy("digest").agg(F.min(F.struct("path", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(shuffled(first), "digest").where(F.struct("path", "pos") != F.col("first")).select("path", "pos", "words")


def key_plan(threshold: int, fingerprints: int) -> list[tuple[tuple[int, int], ...]]:
    """For each table the (shift, bits) pieces of its key.

    With ``threshold + m`` pieces, ``m`` of them agree in any pair within the threshold, so a table for
    each choice of ``m`` pieces misses nothing. ``m`` grows with the number of fingerprints: keys
    stay long enough for tables to hold few fingerprints a key.
    """
    want = math.log2(max(2, fingerprints))
    m = 1
    while m < 4 and FINGERPRINT_BITS * m // (threshold + m) < want and math.comb(threshold + m + 1, m + 1) <= 64:
        m += 1
    count = threshold + m
    edges = [FINGERPRINT_BITS * i // count for i in range(count + 1)]
    cells = [(edges[i], edges[i + 1] - edges[i]) for i in range(count)]
    return list(itertools.combinations(cells, m))


def _keys(fp: Column, threshold: int, fingerprints: int) -> Column:
    out = []
    for table, cells in enumerate(key_plan(threshold, fingerprints)):
        value, total = F.lit(0).cast("bigint"), 0
        for shift, bits in cells:
            piece = fp if bits == FINGERPRINT_BITS else F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1))
            value = F.shiftleft(value, bits).bitwiseOR(piece) if total else piece
            total += bits
        out.append(F.struct(F.lit(table).alias("table"), value.alias("value")))
    return F.array(*out)


def similar_pairs(prints: DataFrame, threshold: int = 3) -> DataFrame:
    """(a, b, distance): pairs of distinct fingerprints (column ``fp``) with 0 < distance <= threshold, a < b."""
    if not 0 <= threshold < FINGERPRINT_BITS:
        raise ValueError("the threshold must be at least 0 and under 64")
    prints = written(prints.select("fp"), "similar-prints")
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"), threshold, prints.count())).alias("key"))
    left, right = keyed.select(F.col("fp").alias("a"), "key"), keyed.select(F.col("fp").alias("b"), "key")
    pairs = left.join(shuffled(right), "key").where("a < b").withColumn("distance", hamming(F.col("a"), F.col("b")).cast("bigint"))
    return pairs.where(F.col("distance") <= threshold).select("a", "b", "distance").distinct()


def leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, stays) of nodes (fp, place) by the greedy rule over edges (a, b), whatever their direction.

    A node stays once all its earlier neighbours are gone and goes once one of them stays. Each round
    settles at least the first undecided node of every component; rounds are written tables.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    place = nodes.select(F.col("fp").alias("b"), F.col("place").alias("place_b"))
    before = both.join(shuffled(nodes.select(F.col("fp").alias("a"), "place")), "a").join(shuffled(place), "b").where("place_b < place")
    before = written(before.select(F.col("a").alias("fp"), F.col("b").alias("earlier")), "leader-edges")
    touched = before.select("fp").distinct().withColumn("blocked", F.lit(True))
    state = written(nodes.select("fp").join(shuffled(touched), "fp", "left").select("fp", F.when(F.col("blocked"), F.lit(None)).otherwise(F.lit(True)).cast("boolean").alias("stays")), "leader-state")
    while state.where("stays is null").limit(1).count():
        known = before.join(shuffled(state.select(F.col("fp").alias("earlier"), F.col("stays").alias("e"))), "earlier")
        verdict = known.groupBy("fp").agg(F.max("e").alias("any"), F.count_if(F.col("e").isNull()).alias("open"))
        rule = F.when(F.col("any"), F.lit(False)).when(F.col("open") == 0, F.lit(True))
        after = written(state.join(shuffled(verdict), "fp", "left").select("fp", F.coalesce("stays", rule).alias("stays")), "leader-state")
        discard(state)
        state = after
    return state


def fuzzy_removed(eligible_blocks: DataFrame, threshold: int = 3) -> DataFrame:
    """(path, pos, words) of blocks within the threshold of an earlier block that stays.

    Equal fingerprints are collapsed to their first place before anything is compared, so boilerplate
    makes one node however often it stands.
    """
    prints = written(eligible_blocks.select("path", "pos", "words", simhash(F.col("norm")).alias("fp")), "block-prints")
    nodes = written(prints.groupBy("fp").agg(F.min(F.struct("path", "pos")).alias("place")), "block-nodes")
    state = leaders(nodes, similar_pairs(nodes, threshold))
    verdict = nodes.join(shuffled(state), "fp")
    return prints.join(shuffled(verdict), "fp").where(~F.col("stays") | (F.struct("path", "pos") != F.col("place"))).select("path", "pos", "words")


def removed_blocks(docs: DataFrame, mode: str = "both", threshold: int = 3, delimiter: str = "\n\n") -> DataFrame:
    """(path, pos, words, how) of every block that goes; how is ``exact`` or ``fuzzy``."""
    if mode not in ("exact", "fuzzy", "both"):
        raise ValueError(f"unknown mode {mode!r}")
    left = eligible(docs, delimiter)
    if mode == "both":
        left = written(left, "blocks-eligible")
    if mode == "fuzzy":
        return fuzzy_removed(left, threshold).withColumn("how", F.lit("fuzzy"))
    exact = exact_removed(left).withColumn("how", F.lit("exact"))
    if mode == "exact":
        return exact
    exact = written(exact, "exact-removed")
    rest = left.join(shuffled(exact.select("path", "pos")), ["path", "pos"], "left_anti")
    return exact.unionByName(fuzzy_removed(rest, threshold).withColumn("how", F.lit("fuzzy")))


def deduplicate(docs: DataFrame, mode: str = "both", threshold: int = 3, delimiter: str = "\n\n") -> DataFrame:
    """(path, text): every document with the blocks that stay, joined; emptied documents keep a row."""
    gone = removed_blocks(docs, mode, threshold, delimiter).groupBy("path").agg(F.collect_set("pos").alias("gone"))
    b = split_blocks(F.col("text"), delimiter)
    kept = F.when(F.col("gone").isNull(), b).otherwise(F.filter(b, lambda x, i: ~F.array_contains("gone", i)))
    return docs.select("path", "text").join(shuffled(gone), "path", "left").select("path", F.array_join(kept, delimiter).alias("text"))


def dedup_stats(docs: DataFrame, removed: DataFrame, delimiter: str = "\n\n") -> DataFrame:
    """One row: total_blocks, removed_exact, removed_fuzzy, words_removed."""
    total = docs.select(F.size(split_blocks(F.col("text"), delimiter)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_blocks"))
    gone = removed.agg(
        F.count_if(F.col("how") == "exact").alias("removed_exact"),
        F.count_if(F.col("how") == "fuzzy").alias("removed_fuzzy"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("words_removed"),
    )
    return total.crossJoin(gone)
