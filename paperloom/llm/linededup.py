"""Incremental, reversible line dedup: sharded cuckoo filters over exact reference counts.

A line is its text without outer spaces. Lines of fewer than ``MIN_CHARS`` characters are never
dropped. Of all other equal lines only the first occurrence stays: first by batch, within a batch
by (doc_id, row hash, line number). The state is a folder of versions. Each version holds

* ``refs``: one row for each occurrence that it added, or, with a negative sign, took away;
* ``counts``: how much it changed the reference count of each line (the exact table);
* ``filters``: one cuckoo filter for each shard of the hash space, with every line whose count
  is above zero;
* ``drops``: one row for each occurrence that its batch lost to an earlier one, or, with a negative
  sign, got back or took along when its document was deleted.

An insertion asks the filters first: what they don't know is new for certain, so only the rest is
looked up among the exact counts. A deletion takes a document's references back; a line whose count
falls to zero leaves its filter, and a line whose first occurrence was deleted gets the next
occurrence as its first, so the text can be given back: :meth:`LineIndex.texts` gives the documents as
they stand after all insertions and deletions. Lines are known by 128 bits of hash. No line is a hot
key: references are counted by partial aggregation, and a shard of the hash space holds each line once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import scan
from paperloom.session import discard, fresh_name, new_folder, written

MIN_CHARS = 20
SLOTS = 4
LOAD = 0.85
DOCS_PER_SHARD = 16384
_LINE = ["h1", "h2"]
_REF = "batch int, doc_id {id}, r1 bigint, r2 bigint, pos int, h1 bigint, h2 bigint, shard int, sign int"
_DROP = "r1 bigint, r2 bigint, pos int, sign int"
_FILTER = "shard int, buckets bigint, items bigint, slots binary"


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots; bulk operations on arrays of 64-bit hashes.

    ``add`` takes keys that aren't in the set yet and ``remove`` keys that are: the caller knows from
    its exact table. Then ``has`` never misses a key.
    """

    def __init__(self, buckets: int, slots: np.ndarray | None = None, items: int = 0):
        self.buckets, self.items = buckets, items
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def sized(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter that holds ``keys``, with room to spare."""
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, len(keys)) / (SLOTS * LOAD)))))
        while True:
            made = cls(buckets)
            if made.add(keys):
                return made
            buckets *= 2

    def has_room(self, more: int) -> bool:
        return self.items + more <= self.buckets * SLOTS * LOAD

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = scan.mix64(keys.view(np.uint64))
        mark = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, self._other(mark, first)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (scan.mix64(mark.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(keys)
        return ((self.slots[a] == mark[:, None]) | (self.slots[b] == mark[:, None])).any(1)

    def add(self, keys: np.ndarray) -> bool:
        """Adds all keys; False, with the filter spoilt, if they can't be placed."""
        mark, bucket, _ = self._places(keys)
        self.items += len(keys)
        chance = np.random.default_rng(5)
        for turn in range(600):
            if not len(mark):
                return True
            order = np.argsort(bucket, kind="stable")
            mark, bucket = mark[order], bucket[order]
            first = np.append(True, bucket[1:] != bucket[:-1])
            rank = np.arange(len(bucket)) - np.maximum.accumulate(np.where(first, np.arange(len(bucket)), 0))
            empty = self.slots[bucket] == 0
            fits = rank < empty.sum(1)
            where = np.argsort(~empty[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
            self.slots[bucket[fits], where] = mark[fits]
            mark, bucket, rank = mark[~fits], bucket[~fits], rank[~fits]
            if turn > 0 and len(mark):  # each has tried both buckets: one of each bucket pushes another out
                lead = np.append(True, bucket[1:] != bucket[:-1])
                out = chance.integers(0, SLOTS, lead.sum())
                pushed = self.slots[bucket[lead], out]
                self.slots[bucket[lead], out] = mark[lead]
                mark[lead] = pushed
            bucket = self._other(mark, bucket)
        return False

    def remove(self, keys: np.ndarray) -> None:
        mark, a, b = self._places(keys)
        self.items -= len(keys)
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((mark, high, low))
        mark, low, high = mark[order], low[order], high[order]
        same = np.append(False, (mark[1:] == mark[:-1]) & (low[1:] == low[:-1]) & (high[1:] == high[:-1]))
        at = np.arange(len(mark))
        rank = at - np.maximum.accumulate(np.where(same, 0, at))
        found = np.concatenate([self.slots[low] == mark[:, None], (self.slots[high] == mark[:, None]) & (low != high)[:, None]], 1)
        hit = found & (np.cumsum(found, 1) == rank[:, None] + 1)
        row, col = np.nonzero(hit)
        self.slots[np.where(col < SLOTS, low[row], high[row]), col % SLOTS] = 0

    def row(self, shard: int) -> pd.DataFrame:
        return pd.DataFrame({"shard": [shard], "buckets": [self.buckets], "items": [self.items], "slots": [self.slots.tobytes()]})

    @classmethod
    def of(cls, row: pd.DataFrame) -> CuckooFilter | None:
        buckets = int(row["buckets"].iloc[0]) if len(row) else 0
        if not buckets:
            return None
        return cls(buckets, np.frombuffer(row["slots"].iloc[0], np.uint16).reshape(buckets, SLOTS).copy(), int(row["items"].iloc[0]))


def _probe(key: tuple, own: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
    """The lines that the shard's filter may know; all of them where the filter is spoilt."""
    made, known = CuckooFilter.of(own), np.zeros(len(lines), bool)
    if made is not None and len(lines):
        known = made.has(lines["h1"].to_numpy())
    return lines[known | (made is None and len(own) > 0)][["h1", "h2"]]


def _change(key: tuple, own: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
    """The shard's filter after lines with ``way`` 1 came, -1 went; 0 names those that stay.

    If the new lines can't be placed the filter counts as spoilt (no buckets): it rules nothing out
    until the next change, which builds it anew.
    """
    made, keys, way = CuckooFilter.of(own), lines["h1"].to_numpy(), lines["way"].to_numpy()
    if made is not None:
        more = keys[way > 0]
        if (way < 0).any():
            made.remove(keys[way < 0])
        if not len(more):
            return made.row(key[0])
        if made.has_room(len(more)):
            return (made if made.add(more) else CuckooFilter(0, items=made.items)).row(key[0])
    return CuckooFilter.sized(keys[way >= 0]).row(key[0])


def _build(key: tuple, lines: pd.DataFrame) -> pd.DataFrame:
    return CuckooFilter.sized(lines["h1"].to_numpy()).row(key[0])


def _row_key(id_col: Column, text: Column) -> list[Column]:
    return [F.xxhash64(id_col, text), F.xxhash64(F.lit("row"), text, id_col)]


def occurrences(docs: DataFrame, shards: int, batch: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row for each line that is long enough to be deduplicated."""
    text = F.col(text_col)
    r1, r2 = _row_key(F.col(id_col), text)

    def hashed(line: Column) -> Column:
        line = F.trim(line)
        return F.struct(F.when(F.length(line) >= MIN_CHARS, F.xxhash64(line)).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"))

    rows = docs.select(F.col(id_col).alias("doc_id"), r1.alias("r1"), r2.alias("r2"), F.transform(F.split(text, "\n", -1), hashed).alias("lines"))
    rows = rows.select("doc_id", "r1", "r2", F.posexplode("lines").alias("pos", "line")).where("line.h1 is not null")
    return rows.select(F.lit(batch).alias("batch"), "doc_id", "r1", "r2", "pos", "line.h1", "line.h2", F.pmod("line.h1", F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("sign"))


def shards_for(docs: DataFrame) -> int:
    """A power of two in proportion to the number of documents, so that a shard fits in memory."""
    return 1 << max(4, int(np.ceil(np.log2(max(1, docs.count()) / DOCS_PER_SHARD))))


class LineIndex:
    """The state under one folder; see the module's description."""

    def __init__(self, spark: SparkSession, path: str, shards: int, id_type: str, version: int = 0):
        self.spark, self.path, self.shards, self.id_type, self.version = spark, path, shards, id_type, version

    @classmethod
    def create(cls, spark: SparkSession, shards: int, id_type: str = "bigint", path: str | None = None) -> LineIndex:
        """An empty index; without ``path`` it lies in the cluster's shared folder."""
        return cls(spark, path or new_folder(spark, "lines"), shards, id_type)

    def _read(self, table: str, versions: range | None = None) -> DataFrame:
        schema = {"refs": _REF.format(id=self.id_type), "counts": "h1 bigint, h2 bigint, change bigint", "filters": _FILTER, "drops": _DROP}[table]
        paths = [f"{self.path}/v{v}/{table}" for v in (versions or range(1, self.version + 1))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def counts(self) -> DataFrame:
        """(h1, h2, count): the exact reference counts above zero."""
        return self._read("counts").groupBy(*_LINE).agg(F.sum("change").alias("count")).where("count > 0")

    def refs(self) -> DataFrame:
        """The live occurrences."""
        where = ["batch", "doc_id", "r1", "r2", "pos", *_LINE, "shard"]
        return self._read("refs").groupBy(*where).agg(F.sum("sign").alias("times")).where("times > 0")

    def filters(self) -> DataFrame:
        """The filters of the last version."""
        return self._read("filters", range(self.version, self.version + 1)) if self.version else self._read("filters")

    def _write(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1}/{table}")
        return self._read(table, range(self.version + 1, self.version + 2))

    def _shard(self, lines: DataFrame) -> DataFrame:
        return lines.withColumn("shard", F.pmod("h1", F.lit(self.shards)).cast("int"))

    def _filter_change(self, changed: DataFrame, live: DataFrame) -> None:
        """Writes the filters; shards without room are built anew from the exact counts."""
        if not self.version:
            self._write(self._shard(changed).select("shard", "h1").groupBy("shard").applyInPandas(_build, _FILTER), "filters")
            return
        changed = self._shard(changed).select("shard", "h1", "way")
        full = self.filters().join(changed.groupBy("shard").agg(F.sum("way").alias("more")), "shard").where(F.col("items") + F.col("more") > F.col("buckets") * SLOTS * LOAD).select("shard")
        full = [r.shard for r in full.collect()]  # at most one number for each shard
        lines = changed
        if full:
            stay = self._shard(live).where(F.col("shard").isin(full)).select("shard", "h1", F.lit(0).alias("way"))
            lines = changed.unionByName(stay)
        self._write(self.filters().groupBy("shard").cogroup(lines.groupBy("shard")).applyInPandas(_change, _FILTER), "filters")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds the documents as one batch: a null text adds nothing, a null doc_id is a value like any other."""
        seen_before = self.version > 0
        occ = self._write(occurrences(docs, self.shards, self.version + 1, id_col, text_col), "refs")
        place = F.struct("doc_id", "r1", "r2", "pos")
        batch = occ.groupBy(*_LINE).agg(F.count("*").alias("change"), F.min(place).alias("owner"))
        if seen_before:
            batch = written(batch, "lines-batch")
        counts = self._write(batch.select(*_LINE, "change"), "counts")
        if seen_before:
            # what the filters don't know is new for certain; only the rest meets the exact counts
            maybe = self.filters().groupBy("shard").cogroup(self._shard(counts).groupBy("shard")).applyInPandas(_probe, "h1 bigint, h2 bigint")
            held = self._read("counts")
            old = written(held.join(maybe, _LINE, "left_semi").groupBy(*_LINE).agg(F.sum("change").alias("count")).where("count > 0").select(*_LINE), "lines-old")
            repeated = batch.where("change > 1").join(old, _LINE, "left_anti").select(*_LINE, "owner").unionByName(old.withColumn("owner", F.lit(None).cast(batch.schema["owner"].dataType)))
            new = counts.join(old, _LINE, "left_anti")
        else:
            repeated, new = batch.where("change > 1").select(*_LINE, "owner"), counts
        self._filter_change(new.withColumn("way", F.lit(1)), self.counts())
        drops = occ.join(repeated, _LINE).where(F.col("owner").isNull() | ~F.col("owner").eqNullSafe(place))
        self._write(drops.select("r1", "r2", "pos", F.lit(1).alias("sign")).distinct(), "drops")
        if seen_before:
            discard(old)
            discard(batch)
        self.version += 1

    def texts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of: int | None = None) -> DataFrame:
        """The documents, all of which are in the index, without the lines that stand elsewhere before.

        All columns of ``docs`` stay; the text holds the kept lines, in order. A document that lost
        lines and has nothing but white space left is dropped, as is a row whose doc_id and text are
        both those of another row. A null text stays null; a text however long is one row of lines. Columns may have any names. With ``of`` only that version's batch counts.
        """
        log = self._read("drops", None if of is None else range(of, of + 1))
        if of is None:
            log = log.groupBy("r1", "r2", "pos").agg(F.sum("sign").alias("sign")).where("sign > 0")
        return _without_lines(docs, log.groupBy("r1", "r2").agg(F.collect_set("pos").alias("pos")), id_col, text_col)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds the documents as one batch and returns them as :meth:`texts` does; empty input gives no rows."""
        self.add(docs, id_col, text_col)
        return self.texts(docs, id_col, text_col, of=self.version)

    def delete(self, doc_ids: DataFrame) -> DataFrame:
        """Takes the documents (a column doc_id) out; returns the lines that thereby become first.

        The rows are (batch, doc_id, r1, r2, pos, h1, h2): an occurrence that had been dropped and is
        now the first of its line. Ids that aren't in the index change nothing.
        """
        ids = doc_ids.select(F.col("doc_id").alias("gone_id")).distinct()
        where = ["batch", "doc_id", "r1", "r2", "pos", *_LINE, "shard"]
        gone = self._read("refs").join(ids, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_semi")
        gone = gone.groupBy(*where).agg(F.sum("sign").alias("times")).where("times > 0")
        held, log = self._read("counts"), self._read("drops")
        taken = self._write(gone.select(*where, (-F.col("times")).cast("int").alias("sign")), "refs")
        counts = self._write(taken.groupBy(*_LINE).agg(F.sum("sign").alias("change")), "counts")
        before = held.join(counts.select(*_LINE), _LINE, "left_semi").groupBy(*_LINE).agg(F.sum("change").alias("count"))
        ended = written(before.join(counts, _LINE).where("count + change = 0").select(*_LINE, F.lit(-1).alias("way")), "lines-ended")
        self._filter_change(ended, self.counts().select(*_LINE).join(ended, _LINE, "left_anti"))
        # the refs of the lines touched, and no others, tell the first occurrence before and after
        touched = self._read("refs").withColumn("older", F.lit(1)).unionByName(taken.withColumn("older", F.lit(0)))
        touched = touched.join(counts.select(*_LINE), _LINE, "left_semi")
        touched = touched.groupBy(*where[:-1]).agg(F.sum(F.col("sign") * F.col("older")).alias("was"), F.sum("sign").alias("times"))
        place = F.struct("batch", "doc_id", "r1", "r2", "pos")
        owners = touched.groupBy(*_LINE).agg(F.min(F.when(F.col("was") > 0, place)).alias("owner"), F.min(F.when(F.col("times") > 0, place)).alias("now"))
        firsts = written(owners.where("now is not null and owner <> now").select("now.*", *_LINE), "lines-firsts")
        lost = log.join(taken.select("r1", "r2").distinct(), ["r1", "r2"], "left_semi").groupBy("r1", "r2", "pos").agg((-F.sum("sign")).cast("int").alias("sign")).where("sign < 0")
        back = firsts.select("r1", "r2", "pos", F.lit(-1).alias("sign"))
        self._write(lost.unionByName(back), "drops")
        discard(ended)
        self.version += 1
        return firsts


def _without_lines(docs: DataFrame, drops: DataFrame, id_col: str, text_col: str) -> DataFrame:
    names = {x: fresh_name(docs, f"_{x}") for x in ("r1", "r2", "pos", "nth")}
    text, pos = F.col(text_col), F.col(names["pos"])
    r1, r2 = _row_key(F.col(id_col), text)
    keyed = docs.withColumn(names["r1"], r1).withColumn(names["r2"], r2)
    drops = drops.select(*(F.col(x).alias(names[x]) for x in ("r1", "r2", "pos")))
    row = [names["r1"], names["r2"]]
    marked = keyed.join(drops, row, "left").withColumn(names["nth"], F.row_number().over(Window.partitionBy(*row).orderBy(*row)))
    marked = marked.where(F.col(names["nth"]).eqNullSafe(1) | text.isNull())
    lines = F.split(text, "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), pos), lambda i: F.get(lines, i))
    out = marked.withColumn(text_col, F.when(pos.isNull(), text).otherwise(F.array_join(kept, "\n")))
    out = out.where(pos.isNull() | F.col(text_col).rlike(r"\S"))
    return out.select(*docs.columns)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: list[Column] | None = None) -> DataFrame:
    """``docs`` through a new index; see :meth:`LineIndex.texts`. Empty input gives no rows.

    With ``batches``, conditions of which each row fulfils one (a null counts as false), the documents are added batch
    by batch, each probing the filters of those before, and a line stays in the first batch that has it.
    """
    index = LineIndex.create(docs.sparkSession, shards_for(docs), dict(docs.dtypes)[id_col])
    for batch in batches or [F.lit(True)]:
        index.add(docs.where(F.coalesce(batch, F.lit(False))), id_col, text_col)
    return index.texts(docs, id_col, text_col)
