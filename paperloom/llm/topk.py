"""Exact top-k inner products by norm-bucketed retrieval.

Probe vectors are sorted by length into buckets; a bucket travels as one row of packed arrays. Queries, too,
are in blocks. Each block first meets the bucket of the longest vectors alone: with the k-th products t
found there no vector shorter than the least ``t / |q|`` of the block can be among its results, so
that only the pairs of a block and a bucket that reaches this length are made, as pairs of numbers, before any
vector is sent. Each block meets its buckets in descending order of their longest vector, so that its k-th best
products rise early. For a query q with k-th product t the local threshold in a bucket is the cosine
``t / (|q| * longest)``:

* above 1 the bucket cannot hold a better vector and is passed over; if that holds for all queries of
  the block, so are all further buckets;
* otherwise length pruning admits the vectors with ``length >= t / |q|``, a prefix of the bucket;
* where the threshold is high enough that the feasible interval of the query's largest coordinate
  holds few of the bucket's vectors (found by binary search in that coordinate's order), coordinate
  pruning admits these instead.

What is admitted is verified by the full product in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import written

K = 10
BUCKET = 2048
BLOCK = 4096
DIGITS = 9
#: Pairs of numbers of so many blocks, or so many buckets with their vectors, are broadcast at most; beyond that Spark joins them.
BROADCAST_ROWS, BROADCAST_BUCKETS = 200_000, 8
_SLACK = 1e-9
#: Coordinate pruning pays where it admits less than this share of what length pruning admits.
_COORDINATE_SHARE = 0.05
_BUCKET = "bucket long, dim int, longest double, ids binary, lengths binary, vectors binary"


def _packed(bucket: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    order = np.argsort(-lengths, kind="stable")
    row = [[bucket], [vectors.shape[1]], [float(lengths[order[0]])], [ids[order].tobytes()], [lengths[order].tobytes()], [vectors[order].tobytes()]]
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["bucket", "dim", "longest", "ids", "lengths", "vectors"])


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 24, {}
        for batch in batches:
            dims, ids = batch.column("dim").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False)
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                v = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                old_ids, old = held.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
                i, v = np.concatenate([old_ids, ids[at]]), np.concatenate([old, v])
                while len(i) >= size:
                    yield _packed(number, i[:size], v[:size])
                    number, i, v = number + 1, i[size:], v[size:]
                held[dim] = (i, v)
        for i, v in held.values():
            if len(i):
                yield _packed(number, i, v)
                number += 1

    return run


def _cells(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.float64), vectors


class _Block:
    """Queries and their best products so far."""

    def __init__(self, k: int, ids: np.ndarray, lengths: np.ndarray, vectors: np.ndarray):
        self.k, self.ids, self.lengths, self.vectors = k, ids, lengths, vectors
        n = len(ids)
        self.best, self.best_id = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def threshold(self) -> np.ndarray:
        return self.best[:, -1] - _SLACK

    def offer(self, row: np.ndarray, value: np.ndarray, other: np.ndarray) -> None:
        """Takes verified products in: best first, then least id."""
        keep = other != self.ids[row]
        row, value, other = row[keep], np.round(value[keep], DIGITS), other[keep]
        rows = np.unique(row)
        old = self.best[rows]
        row = np.concatenate([np.repeat(rows, self.k), row])
        value, other = np.concatenate([old.ravel(), value]), np.concatenate([self.best_id[rows].ravel(), other])
        order = np.lexsort((other, -value, row))
        row, value, other = row[order], value[order], other[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        take = first[:, None] + np.arange(self.k)
        self.best[rows], self.best_id[rows] = value[take], other[take]

    def meet(self, ids: np.ndarray, lengths: np.ndarray, vectors: np.ndarray) -> None:
        t, longest = self.threshold(), lengths[0]
        need = np.where(np.isfinite(t), t, -np.inf)
        open_ = self.lengths * longest >= need
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(self.lengths > 0, need / self.lengths, np.where(need <= 0, -np.inf, np.inf))
            cosine = np.where(self.lengths * longest > 0, need / (self.lengths * longest), -np.inf)
        prefix = np.searchsorted(-lengths, -(least - _SLACK), side="right")
        prefix[need <= 0] = len(ids)
        by_coordinate = np.zeros(len(t), bool)
        trial = np.flatnonzero(open_ & (cosine > 0.6) & (lengths[-1] > 0))
        if len(trial):
            by_coordinate[trial] = self._coordinate(trial, cosine[trial], prefix[trial], ids, lengths, vectors)
        dense = np.flatnonzero(open_ & ~by_coordinate & (prefix > 0))
        for i in range(0, len(dense), 512):
            rows = dense[i : i + 512]
            width = int(prefix[rows].max())
            product = self.vectors[rows] @ vectors[:width].T
            bar = t[rows]
            unset = ~np.isfinite(bar)
            if unset.any() and width > self.k:  # a first bar from this bucket
                first = np.where(self.ids[rows[unset]][:, None] == ids[:width], -np.inf, product[unset])
                bar = bar.copy()
                bar[unset] = np.partition(first, width - self.k, axis=1)[:, width - self.k] - 2 * _SLACK
            r, c = np.nonzero(product >= bar[:, None])
            self.offer(rows[r], product[r, c], ids[c])

    def _coordinate(self, rows: np.ndarray, cosine: np.ndarray, prefix: np.ndarray, ids: np.ndarray, lengths: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Works off the rows for which the interval of their largest coordinate admits few; which those are."""
        unit = self.vectors[rows] / self.lengths[rows][:, None]
        focus = np.abs(unit).argmax(1)
        x = unit[np.arange(len(rows)), focus]
        root = np.sqrt(np.maximum(0, (1 - x * x) * (1 - cosine * cosine)))
        low = np.where(-x >= cosine, -1.0, x * cosine - root) - _SLACK
        high = np.where(x >= cosine, 1.0, x * cosine + root) + _SLACK
        done = np.zeros(len(rows), bool)
        for f in np.unique(focus):
            value = vectors[:, f] / lengths
            order = np.argsort(value)
            ranked = value[order]
            own = np.flatnonzero(focus == f)
            a, b = np.searchsorted(ranked, low[own]), np.searchsorted(ranked, high[own], side="right")
            few = (b - a) < _COORDINATE_SHARE * prefix[own]
            done[own[few]] = True
            a, n, own = a[few], (b - a)[few], own[few]
            q = np.repeat(rows[own], n)
            c = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
            product = np.einsum("ij,ij->i", self.vectors[q], vectors[c])
            good = product >= self.threshold()[q]
            self.offer(q[good], product[good], ids[c[good]])
        return done


def _floor(k: int):
    """(block, floor): the length that a vector needs to be among the results of the block, from its first bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(k, *_cells(row))
                block.meet(*_cells({"dim": row["dim"], "ids": row["p_ids"], "lengths": row["p_lengths"], "vectors": row["p_vectors"]}))
                t = block.threshold()
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(np.isfinite(t) & (t > 0) & (block.lengths > 0), t / block.lengths, 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([float(least.min()) * (1 - _SLACK) - _SLACK])], names=["block", "floor"])

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, closed = None, False

        def result(b: _Block) -> pa.RecordBatch:
            r, c = np.nonzero(np.isfinite(b.best))
            cols = [pa.array(b.ids[r]), pa.array(c.astype(np.int64) + 1), pa.array(b.best_id[r, c]), pa.array(b.best[r, c])]
            return pa.RecordBatch.from_arrays(cols, names=["vec_id", "rank", "neighbor_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["is_query"]:
                    if block is not None:
                        yield result(block)
                    block, closed = _Block(k, *_cells(row)), False
                elif not closed:
                    closed = not (block.lengths * row["longest"] >= block.threshold()).any()
                    if not closed:
                        block.meet(*_cells(row))
        if block is not None:
            yield result(block)

    return run


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def top_k(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): the k largest inner products of every query vector, exactly.

    Queries are the rows for which the condition ``queries`` (on the columns of ``vectors``) holds, without it
    all rows; candidates are all rows. Scores are rounded to nine decimals; equal scores are ranked by
    neighbor_id. A vector is not its own neighbour, nor is any row with its id; of rows that repeat an id and
    a vector one counts, and an id with several vectors is several queries and several candidates. Ids are
    whole numbers, or texts that Spark casts to them; a text that is no number is an error under ANSI
    rules and left out otherwise. Rows whose id or vector is null or empty, or holds a null, NaN or
    infinity, are left out. Vectors of different dimension are searched apart. A vector with fewer than k
    others has fewer neighbours; no rows give no rows. Other columns, whatever their names, are not looked at.
    """
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    good = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), asked.alias("asked")).where("id is not null and size(v) > 0")
    good = good.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).groupBy("id", "v").agg(F.max("asked").alias("asked"))
    good = written(good.select("id", "v", "asked", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("square")), "topk-vectors")
    own = good.where("asked").drop("asked")
    parts, turns = max(1, -(-good.count() // (4 * BUCKET))), max(1, -(-own.count() // BLOCK))
    buckets = written(good.drop("asked").repartitionByRange(parts, "dim", F.desc("square")).sortWithinPartitions("dim", F.desc("square")).mapInArrow(_pack(BUCKET), _BUCKET), "topk-buckets")
    blocks = written(own.repartition(turns, "id").mapInArrow(_pack(BLOCK), _BUCKET), "topk-blocks")
    heads = blocks.select(F.col("bucket").alias("block"), "dim")
    cells = ["dim", "longest", "ids", "lengths", "vectors"]
    longest = buckets.groupBy("dim").agg(F.max_by("bucket", "longest").alias("bucket"))
    tops = buckets.join(_small(longest.select("bucket")), "bucket").select("dim", *(F.col(c).alias(f"p_{c}") for c in cells[2:]))
    floors = written(blocks.withColumnRenamed("bucket", "block").join(_small(tops, BROADCAST_BUCKETS), "dim").mapInArrow(_floor(k), "block bigint, floor double"), "topk-floors")
    needs = heads.join(floors, "block")
    met = buckets.select("bucket", "dim", "longest").join(_small(needs), "dim").where("longest >= floor").select("block", "bucket")
    probes = met.join(buckets, "bucket").select("block", F.lit(False).alias("is_query"), *cells)
    meet = blocks.select(F.col("bucket").alias("block"), F.lit(True).alias("is_query"), *cells).unionByName(probes)
    meet = meet.repartition(max(1, heads.count()), "block").sortWithinPartitions("block", F.desc("is_query"), F.desc("longest"))
    return meet.mapInArrow(_search(k), "vec_id bigint, rank bigint, neighbor_id bigint, score double")
