"""Near-duplicate groups by SimHash and multi-index hashing.

A text becomes 128 bits: its distinct lower-case words vote, each with weight ``1 + 1.5 ln(times)``.
Two texts are near duplicates when their fingerprints differ in at most ``MAX_BITS`` = 14 bits;
groups are the connected components of that relation.

The search is exact. The fingerprint is cut into five segments of 25 or 26 bits. Two fingerprints
that differ in at most 14 bits differ in at most 2 bits within some segment, and two values at most
2 bits apart have a common value at most 1 bit from either. So each fingerprint enters the table of
every segment under its Hamming ball of radius 1 (133 entries in all), and whoever shares an entry
is verified on all 128 bits. A table is cut into blocks by the first bits of its keys; a fingerprint
is sent to the few blocks that its ball touches and its entries are made there. Equal fingerprints
are collapsed first. All pairs of an entry are compared, first on one half of the fingerprint, which
most fail; only pairs that join two trees of the block's forest leave it, so clusters of many near
copies give rows in proportion to their members, not to their pairs. No entry is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import scan
from paperloom.session import discard, fresh_name, written

BITS = 128
MAX_BITS = 14
SEGMENTS = ((0, 26), (26, 26), (52, 26), (78, 25), (103, 25))
#: A block of a segment's table holds about as many fingerprints, or the bits that name it are at their limits.
BLOCK_PRINTS, LEAST_TOP, MOST_TOP = 1 << 14, 4, 22
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
#: Runs of equal keys up to this size are compared together by shifts, longer ones each by tiles of so many rows and columns.
_SHORT_RUN, _TILE = 256, (128, 1024)
#: Table entries that a worker makes at a time.
_ENTRIES = 1 << 21


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high half, low half, number of words) of each text, halves as int64."""
    data, offsets = scan.string_buffers(column)
    n = len(offsets) - 1
    halves, count = np.zeros((n, 2), np.uint64), np.zeros(n, np.int64)
    for i, j, part, own in scan.slices(data, offsets):
        part = scan.lower_latin(part)
        start, end, row = scan.plain_words(part, own)
        count[i:j] = np.bincount(row, minlength=j - i)
        if not len(row):
            continue
        key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (scan.word_hashes(part, start, end) >> np.uint64(20)))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        times = np.diff(np.append(first, len(key)))
        weight = 1 + 1.5 * np.log(times)
        key = key[first]
        owner = (key >> np.uint64(44)).astype(np.int64)
        word = key & np.uint64((1 << 44) - 1)
        vector = np.stack([scan.mix64(word + np.uint64(1 << 50)), scan.mix64(word + np.uint64(1 << 51))], 1)
        octets = vector.astype(">u8").view(np.uint8).reshape(-1, 16)
        half = np.bincount(owner, weights=weight, minlength=j - i) / 2
        bits = np.empty((j - i, BITS), bool)
        for b in range(16):
            votes = np.bincount(owner * 256 + octets[:, b], weights=weight, minlength=(j - i) * 256).reshape(-1, 256)
            bits[:, b * 8 : b * 8 + 8] = votes @ _BYTE_BITS > half[:, None] + 1e-9
        halves[i:j] = np.packbits(bits, axis=1).view(">u8").astype(np.uint64)
    halves = halves.view(np.int64)
    return halves[:, 0], halves[:, 1], count


def _fingerprint(text: pa.Array) -> pa.Array:
    hi, lo, count = fingerprints(text)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(hi)), pa.array(np.ascontiguousarray(lo)), pa.array(count)], names=["hi", "lo", "words"])


def fingerprint(text: Column) -> Column:
    """The two halves of the fingerprint and the number of words."""
    # so that a filter on it isn't pushed below and the fingerprint made twice
    return F.arrow_udf(_fingerprint, "hi bigint, lo bigint, words bigint").asNondeterministic()(text)


def segment_value(hi: np.ndarray, lo: np.ndarray, segment: int) -> np.ndarray:
    """The bits of one segment of each fingerprint, as uint64."""
    at, size = SEGMENTS[segment]
    hi, lo = hi.view(np.uint64), lo.view(np.uint64)
    shift = BITS - at - size
    if shift >= 64:
        value = hi >> np.uint64(shift - 64)
    elif shift + size <= 64:
        value = lo >> np.uint64(shift)
    else:
        value = (hi << np.uint64(64 - shift)) | (lo >> np.uint64(shift))
    return value & np.uint64((1 << size) - 1)


def _flips(bits: range) -> np.ndarray:
    return np.append(np.uint64(0), np.uint64(1) << np.array(bits, np.uint64))


def _emit(top: int):
    """Sends each fingerprint to the table blocks in which its balls lie.

    A block is a segment and the ``top`` first bits of its value: the ball of radius 1 lies in the
    fingerprint's own block but for the flips of these bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for segment, (_, size) in enumerate(SEGMENTS):
                own = segment_value(hi, lo, segment) >> np.uint64(size - top)
                blocks = (own[:, None] ^ _flips(range(top))[None] | np.uint64(segment << 32)).astype(np.int64)
                each = blocks.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(blocks.ravel()), pa.array(np.repeat(hi, each)), pa.array(np.repeat(lo, each))], names=["block", "hi", "lo"])

    return run


def block_entries(block: int, top: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, indices of points): the table entries of one block, sorted by key."""
    segment, bits = block >> 32, np.uint64(block & 0xFFFFFFFF)
    size = SEGMENTS[segment][1]
    low = size - top
    value = segment_value(np.ascontiguousarray(points[:, 0]), np.ascontiguousarray(points[:, 1]), segment)
    home = (value >> np.uint64(low)) == bits
    at = np.flatnonzero(home)
    inside = (value[at][:, None] ^ _flips(range(low))[None]).ravel()
    guests = np.flatnonzero(~home)
    moved = (value[guests] & np.uint64((1 << low) - 1)) | (bits << np.uint64(low))
    keys = np.concatenate([inside, moved])
    index = np.concatenate([np.repeat(at, low + 1), guests])
    both = np.sort((keys << np.uint64(32)) | index.astype(np.uint64))
    return both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of two halves; shapes broadcast."""
    # numpy counts the bits of a signed number's absolute value
    apart = [np.bitwise_count((a[..., h] ^ b[..., h]).view(np.uint64)).astype(np.int16) for h in (0, 1)]
    return apart[0] + apart[1]


class Forest:
    """Trees over the points of a block, and the near pairs that joined them: no cycle, every link kept."""

    def __init__(self, points: np.ndarray, segment: int):
        self.parent = np.arange(len(points))
        self.pairs: list[np.ndarray] = []
        halves = [np.ascontiguousarray(points[:, h]).view(np.uint64) for h in (0, 1)]
        # of the half with fewer bits that a shared entry has made alike already, most pairs fail at once
        self.sieve, self.other = halves[::-1] if segment < 2 else halves

    def roots(self, points: np.ndarray) -> np.ndarray:
        root = self.parent[points]
        while not np.array_equal(up := self.parent[root], root):
            root = up
        self.parent[points] = root
        return root

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins those of the pairs that are near."""
        near = np.bitwise_count(self.sieve[a] ^ self.sieve[b]) + np.bitwise_count(self.other[a] ^ self.other[b]) <= MAX_BITS
        a, b = a[near], b[near]
        while len(a):
            root_a, root_b = self.roots(a), self.roots(b)
            apart = root_a != root_b
            a, b, root_a, root_b = a[apart], b[apart], root_a[apart], root_b[apart]
            upper, at = np.unique(np.maximum(root_a, root_b), return_index=True)
            self.parent[upper] = np.minimum(root_a, root_b)[at]
            self.pairs.append(np.stack([a[at], b[at]], 1))

    def join_short(self, index: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Joins within many runs of ``index`` at once, by shifts; longest runs first, so that those still going stand in front."""
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        ends = np.cumsum(size)
        own = index[np.arange(ends[-1]) + np.repeat(first - (ends - size), size)]
        run, sieve = np.repeat(np.arange(len(size)), size), self.sieve[own]
        for ahead in range(1, int(size[0])):
            going = ends[np.searchsorted(-size, -ahead) - 1]
            hit = np.flatnonzero(np.bitwise_count(sieve[: going - ahead] ^ sieve[ahead:going]) <= MAX_BITS)
            hit = hit[run[hit] == run[hit + ahead]]
            self.join(own[hit], own[hit + ahead])

    def join_long(self, own: np.ndarray) -> None:
        """Joins within one run, tile by tile; a tile whose points are all in one tree already is passed over."""
        own = own[np.argsort(self.roots(own), kind="stable")]
        sieve = self.sieve[own]
        for i in range(0, len(own), _TILE[0]):
            rows = own[i : i + _TILE[0]]
            for j in range(i, len(own), _TILE[1]):
                columns = own[j : j + _TILE[1]]
                root = self.roots(rows)
                if (root == root[0]).all() and (self.roots(columns) == root[0]).all():
                    continue
                hit = np.flatnonzero(np.bitwise_count(sieve[i : i + len(rows), None] ^ sieve[None, j : j + len(columns)]) <= MAX_BITS)
                self.join(rows[hit // len(columns)], columns[hit % len(columns)])


def _join_runs(forest: Forest, keys: np.ndarray, index: np.ndarray) -> None:
    """Joins the near pairs within each run of equal keys."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(first, len(keys)))
    short = (size > 1) & (size <= _SHORT_RUN)
    if short.any():
        forest.join_short(index, first[short], size[short])
    for f, n in zip(first[size > _SHORT_RUN], size[size > _SHORT_RUN], strict=True):
        forest.join_long(index[f : f + n])


def block_edges(block: int, top: int, points: np.ndarray) -> np.ndarray:
    """Edges, as rows of four halves, that connect what the near pairs sharing an entry of one block connect.

    Each is a near pair, and there are fewer than points. They depend on the set of points alone: a task that is run
    again gives the same edges. A block of many entries is worked off by parts of its keys.
    """
    points = points[np.lexsort((points[:, 1], points[:, 0]))]
    segment = block >> 32
    size = SEGMENTS[segment][1]
    value = segment_value(np.ascontiguousarray(points[:, 0]), np.ascontiguousarray(points[:, 1]), segment)
    forest = Forest(points, segment)
    todo = [(block & 0xFFFFFFFF, top, np.arange(len(points)))]
    while todo:
        bits, deep, rows = todo.pop()
        home = int(((value[rows] >> np.uint64(size - deep)) == np.uint64(bits)).sum())
        if deep < size and home * (size - deep) + len(rows) > _ENTRIES:
            for part in (2 * bits, 2 * bits + 1):
                reach = np.bitwise_count((value[rows] >> np.uint64(size - deep - 1)) ^ np.uint64(part)) <= 1
                todo.append((part, deep + 1, rows[reach]))
            continue
        keys, index = block_entries(segment << 32 | bits, deep, points[rows])
        _join_runs(forest, keys, rows[index])
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *forest.pairs])
    return np.concatenate([points[pairs[:, 0]], points[pairs[:, 1]]], 1)


def _verify(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            rows = block_edges(int(held[0][0][0]), top, np.concatenate([p for _, p in held]))
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, c])) for c in range(4)], names=["hi_a", "lo_a", "hi_b", "lo_b"])

        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            points = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2)], 1)
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
            for i, j in zip(starts, [*starts[1:], len(block)], strict=True):
                if held and held[0][0][0] != block[i]:
                    yield made()
                    held = []
                held.append((block[i:j], points[i:j]))
        if held:
            yield made()

    return run


def _components(edges: DataFrame) -> DataFrame:
    """(hi, lo, root_hi, root_lo): each node and the least node of its component.

    Least labels spread along edges, and each round also takes the label of the label, so the
    rounds follow the logarithm of the diameter. Every round is a written table.
    """
    node = lambda x: F.struct(F.col(f"hi_{x}").alias("hi"), F.col(f"lo_{x}").alias("lo"))
    ways = F.explode(F.array(F.struct(node("a").alias("u"), node("b").alias("v")), F.struct(node("b").alias("u"), node("a").alias("v"))))
    both = written(edges.select(ways.alias("way")).select("way.u", "way.v").distinct(), "simhash-edges")
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("l")), "simhash-labels")
    while True:
        spread = both.join(labels.select(F.col("u").alias("v"), F.col("l").alias("lv")), "v").groupBy("u").agg(F.min("lv").alias("lv"))
        stepped = labels.join(spread, "u").select("u", "l", F.least("l", "lv").alias("n"))
        jump = labels.select(F.col("u").alias("n"), F.col("l").alias("ln"))
        after = written(stepped.join(jump, "n").select("u", F.least("n", "ln").alias("l"), (F.least("n", "ln") != F.col("l")).alias("moved")), "simhash-labels")
        moved = after.where("moved").limit(1).count()
        discard(labels)
        labels = after.select("u", "l")
        if not moved:
            break
    discard(both)
    return labels.select("u.hi", "u.lo", F.col("l.hi").alias("root_hi"), F.col("l.lo").alias("root_lo"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, distance): every document of a group of two or more.

    ``group_id`` is the least doc_id of the group, ``distance`` the bits in which the fingerprint of
    the document differs from that of the group's first document. Rows that repeat a doc_id count
    as one document each; a group has two or more rows, so a row that is there twice makes a group
    and is listed twice. Texts that are null or hold no word are no one's duplicate. A null doc_id is
    listed like any other and orders before all others. Very long texts are read whole; ties for the first of a group go by doc_id. Other
    columns of ``docs``, whatever their names, are not looked at.
    No rows give no rows.
    """
    prints = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("f")).select("doc_id", "f.hi", "f.lo", "f.words")
    prints = written(prints.where("words > 0").drop("words"), "simhash-prints")
    distinct = written(prints.groupBy("hi", "lo").agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("n")), "simhash-distinct")
    top = max(LEAST_TOP, int(np.ceil(np.log2(max(1, distinct.count()) / BLOCK_PRINTS))))
    blocks = distinct.select("hi", "lo").mapInArrow(_emit(min(top, MOST_TOP)), "block bigint, hi bigint, lo bigint")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = blocks.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_verify(min(top, MOST_TOP)), "hi_a bigint, lo_a bigint, hi_b bigint, lo_b bigint")
    roots = _components(edges)
    nodes = distinct.join(roots, ["hi", "lo"], "left").select(
        "hi", "lo", "first", "n", F.coalesce("root_hi", "hi").alias("root_hi"), F.coalesce("root_lo", "lo").alias("root_lo")
    )
    groups = nodes.groupBy("root_hi", "root_lo").agg(F.min(F.struct("first", "hi", "lo")).alias("lead"), F.sum("n").alias("n")).where("n > 1")
    led = nodes.join(groups.select("root_hi", "root_lo", "lead"), ["root_hi", "root_lo"]).select("hi", "lo", F.col("lead.first.doc_id").alias("group_id"), F.col("lead.hi").alias("lead_hi"), F.col("lead.lo").alias("lead_lo"))
    bits = F.bit_count(F.col("hi").bitwiseXOR(F.col("lead_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("lead_lo")))
    return prints.join(led, ["hi", "lo"]).select("doc_id", "group_id", bits.cast("bigint").alias("distance"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but the first document (least doc_id) of each near-duplicate group.

    Columns stay as they are. Rows that repeat the doc_id of the kept document stay with it if their
    text is the same: give documents distinct ids where that is not wanted. Documents without words
    all stay.
    """
    gone = near_duplicate_groups(docs, id_col, text_col).where(~F.col("doc_id").eqNullSafe(F.col("group_id"))).select(F.col("doc_id").alias(fresh_name(docs, "gone_id"))).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone[gone.columns[0]]), "left_anti")
