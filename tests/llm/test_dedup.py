"""Near duplicates (op8) and lines (op9) against brute force, with edge cases."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paperloom.llm import linededup, simhash

WORDS = [f"w{i}" for i in range(400)]


def texts(seed=0, n=60):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        base = list(rng.choice(WORDS, 120))
        out.append(" ".join(base))
        for k in range(int(rng.integers(0, 4))):
            copy = list(base)
            for at in rng.integers(0, 120, int(rng.integers(0, 12))):
                copy[at] = str(rng.choice(WORDS))
            out.append(" ".join(copy))
    return out


def brute_groups(values):
    hi, lo, words = simhash.fingerprints(pa.array(values))
    points = np.stack([hi, lo], 1)
    near = simhash.distances(points[:, None], points[None]) <= simhash.MAX_BITS
    near &= (words[:, None] > 0) & (words[None] > 0)
    label = list(range(len(values)))
    for i in range(len(values)):
        todo = [i]
        while todo:
            j = todo.pop()
            for k in np.flatnonzero(near[j]):
                if label[k] > label[i]:
                    label[k] = label[i]
                    todo.append(k)
    groups = {}
    for i, g in enumerate(label):
        groups.setdefault(g, []).append(i)
    return sorted(tuple(g) for g in groups.values() if len(g) > 1)


def test_groups_equal_brute_force(spark):
    values = texts() + ["", None, "  ", "same text here", "same text here", "word " * 50000]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(values)], "doc_id bigint, text string, hi string")
    got = {}
    for r in simhash.near_duplicate_groups(docs).collect():
        got.setdefault(r.group_id, []).append(r.doc_id)
    assert sorted(tuple(sorted(g)) for g in got.values()) == brute_groups(values)
    assert all(g == min(v) for g, v in got.items())
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(values) - sum(len(v) - 1 for v in got.values())


def test_near_duplicate_edges(spark):
    rows = [(None, "one two three"), (1, "one two three"), (2, "one two three"), (2, "one two three"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = simhash.near_duplicate_groups(docs).collect()
    assert len(got) == 4 and {r.group_id for r in got} == {None}
    assert sorted((r.doc_id for r in simhash.drop_near_duplicates(docs).collect()), key=str) == [3, 4, None]
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == 0


def test_blocks_find_every_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, (40, 2))
    points = [tuple(p) for p in base]
    for p in base:
        for _ in range(3):
            q = p.view(np.uint64).copy()
            for b in rng.choice(128, int(rng.integers(0, simhash.MAX_BITS + 3)), replace=False):
                q[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
            points.append(tuple(q.view(np.int64)))
    points = np.array(sorted(set(points)), np.int64)
    top, edges = 4, set()
    for batch in simhash._emit(top)(iter([pa.RecordBatch.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], names=["hi", "lo"])])):
        block = batch.column(0).to_numpy()
        own = np.stack([batch.column(c).to_numpy() for c in (1, 2)], 1)
        for b in np.unique(block):
            for e in simhash.block_edges(int(b), top, own[block == b]):
                edges.add((tuple(e[:2]), tuple(e[2:])))
    near = {(tuple(a), tuple(b)) for i, a in enumerate(points) for b in points[i + 1 :] if simhash.distances(a, b) <= simhash.MAX_BITS}
    assert all(simhash.distances(np.array(a), np.array(b)) <= simhash.MAX_BITS for a, b in edges)
    parent = {tuple(p): tuple(p) for p in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    assert near and all(find(a) == find(b) for a, b in near)


def block_labels(points, top):
    """The least index that the edges of all blocks connect with each point, and the number of edges of each block and its points."""
    label, counts = {tuple(p): i for i, p in enumerate(points.tolist())}, []
    edges = []
    for batch in simhash._emit(top)(iter([pa.RecordBatch.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], names=["hi", "lo"])])):
        block = batch.column(0).to_numpy()
        own = np.stack([batch.column(c).to_numpy() for c in (1, 2)], 1)
        for b in np.unique(block):
            found = simhash.block_edges(int(b), top, own[block == b])
            counts.append((len(found), int((block == b).sum())))
            edges += [(tuple(e[:2]), tuple(e[2:])) for e in found.tolist()]
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    return [label[tuple(p)] for p in points.tolist()], counts


def true_labels(points):
    """The same by Python's integers alone."""
    value = [(int(hi) % 2**64) << 64 | int(lo) % 2**64 for hi, lo in points]
    label = list(range(len(value)))
    for i in range(len(value)):
        todo = [i] if label[i] == i else []
        while todo:
            j = todo.pop()
            for k, v in enumerate(value):
                if label[k] > i and (value[j] ^ v).bit_count() <= simhash.MAX_BITS:
                    label[k] = i
                    todo.append(k)
    return label


def flipped(point, bits):
    q = np.array(point).view(np.uint64).copy()
    for b in bits:
        q[b // 64] ^= np.uint64(1) << np.uint64(63 - b % 64)
    return q.view(np.int64)


def test_first_bit_of_a_half_counts_as_one():
    point = np.array([5, -9], np.int64)
    for bits in ([0], [64], [0, 64], [0, 1, 2, 64, 127], list(range(15))):
        other = flipped(point, bits)
        assert simhash.distances(point[None], other[None]).tolist() == [len(bits)]
        labels, _ = block_labels(np.array([point, other]), 4)
        assert labels == ([0, 0] if len(bits) <= simhash.MAX_BITS else [0, 1])


def test_block_edges_are_a_forest_of_near_pairs(monkeypatch):
    """Clusters of many near copies, members of entries longer than a tile, blocks in parts."""
    rng = np.random.default_rng(8)
    base = rng.integers(-(2**62), 2**62, 2)
    points = [base]
    points += [flipped(base, rng.choice(78, int(rng.integers(1, 7)), replace=False)) for _ in range(260)]
    points += [flipped(base, rng.choice(78, int(rng.integers(14, 24)), replace=False)) for _ in range(260)]
    points += [flipped(points[i], rng.choice(128, int(rng.integers(5, 17)), replace=False)) for i in range(1, 261, 4)]
    points = np.unique(np.array(points, np.int64), axis=0)
    truth = true_labels(points)
    for entries in (1 << 21, 500):
        monkeypatch.setattr(simhash, "_ENTRIES", entries, raising=False)
        labels, counts = block_labels(points, 4)
        assert labels == truth
        assert all(edges < own for edges, own in counts)
    assert 1 < len(set(truth)) < len(points)


LONG = ["the first line is long enough to count", "the second line is long enough too", "a third line that is long as well"]


def brute_lines(rows):
    seen, out, done = set(), [], set()
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if (doc_id, text) in done and text is not None:
            continue
        done.add((doc_id, text))
        if text is None:
            out.append((doc_id, None))
            continue
        kept = []
        for line in text.split("\n"):
            key = line.strip(" ")
            if len(key) >= linededup.MIN_CHARS and key in seen:
                continue
            seen.add(key)
            kept.append(line)
        if len(kept) == len(text.split("\n")) or "\n".join(kept).strip():
            out.append((doc_id, "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    pool = LONG + [f"  {LONG[0]}  ", "short", "", *(f"line number {i} with some more words" for i in range(30))]
    rows = [(i, "\n".join(rng.choice(pool, int(rng.integers(1, 9))))) for i in range(40)]
    rows += [(50, None), (51, ""), (None, LONG[0] + "\nfresh words of a row without id"), rows[3], (52, "x" * 200_000 + "\n" + LONG[1])]
    docs = spark.createDataFrame([(*r, 7, "clash") for r in rows], "doc_id bigint, text string, pos int, h1 string")
    got = linededup.dedup_lines(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute_lines(rows)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_batches_and_deletion_are_reversible(spark):
    schema = "doc_id bigint, text string"
    index = linededup.LineIndex.create(spark, 16)
    one = spark.createDataFrame([(1, "\n".join(LONG[:2])), (2, LONG[2])], schema)
    two = spark.createDataFrame([(3, "\n".join([LONG[0], "only here, and long enough to count"])), (4, LONG[2])], schema)
    assert index.insert(one).count() == 2
    assert [(r.doc_id, r.text) for r in index.insert(two).collect()] == [(3, "only here, and long enough to count")]
    counts = sorted(r["count"] for r in index.counts().collect())
    assert counts == [1, 1, 2, 2]
    first = index.delete(spark.createDataFrame([(1,), (99,)], "doc_id bigint")).collect()
    assert [(r.doc_id, r.pos) for r in first] == [(3, 0)]
    assert sorted(r["count"] for r in index.counts().collect()) == [1, 1, 2]
    again = index.insert(spark.createDataFrame([(5, "\n".join([LONG[1], LONG[2]]))], schema)).collect()
    assert [r.text for r in again] == [LONG[1]]


def brute_incremental(steps):
    """The texts after steps (add, rows) and (delete, ids), by lists of occurrences."""
    live, n = [], 0
    for step, what in steps:
        if step == "add":
            n += 1
            live += [(n, i, t) for i, t in sorted(set(what), key=lambda r: (r[0] is not None, r[0] or 0))]
        else:
            live = [x for x in live if x[1] not in what]
    live.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0))
    return brute_lines_in_order([(i, t) for _, i, t in live])


def brute_lines_in_order(rows):
    seen, out = set(), []
    for doc_id, text in rows:
        kept = []
        for line in text.split("\n"):
            key = line.strip(" ")
            if len(key) >= linededup.MIN_CHARS and key in seen:
                continue
            seen.add(key)
            kept.append(line)
        if len(kept) == len(text.split("\n")) or "\n".join(kept).strip():
            out.append((doc_id, "\n".join(kept)))
    return sorted(out, key=str)


def test_insertions_and_deletions_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    pool = [*LONG, "short", *(f"line number {i} with some more words" for i in range(40))]
    made = lambda a, b: [(i, "\n".join(rng.choice(pool, int(rng.integers(1, 9))))) for i in range(a, b)]
    one, two, three = made(0, 25), [*made(25, 45), (None, LONG[1])], made(45, 50)
    gone = {0, 3, 5, 6, 30, None}
    again = [r for r in one + two if r[0] in gone]
    steps = [("add", one), ("add", two), ("delete", gone), ("add", three), ("add", again), ("delete", {1, 45}), ("delete", {999})]
    schema, index = "doc_id bigint, text string", linededup.LineIndex.create(spark, 16)
    for step, what in steps:
        if step == "add":
            index.add(spark.createDataFrame(what, schema))
        else:
            index.delete(spark.createDataFrame([(i,) for i in what], "doc_id bigint"))
    live = [r for r in one + two + three if r[0] not in {1, 45}]
    got = index.texts(spark.createDataFrame(live, schema))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute_incremental(steps)
    held = {}
    for _, t in live:
        for line in t.split("\n"):
            if len(line.strip(" ")) >= linededup.MIN_CHARS:
                held[line.strip(" ")] = held.get(line.strip(" "), 0) + 1
    assert sorted(r["count"] for r in index.counts().collect()) == sorted(held.values())


def test_batches_probe_the_filters(spark):
    rows = [(i, LONG[i % 3] + f"\nonly in document number {i} of all") for i in range(12)] + [(None, LONG[0]), (20, None), (21, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = []
    real = linededup.LineIndex.filters
    try:
        linededup.LineIndex.filters = lambda self: asked.append(self.version) or real(self)
        odd = F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))
        got = linededup.dedup_lines(docs, batches=[odd, ~odd]).collect()
    finally:
        linededup.LineIndex.filters = real
    assert asked and set(asked) == {1}
    want = brute_lines_in_order(sorted((r for r in rows if r[1] is not None), key=lambda r: (not (r[0] or 0) % 2, r[0] is not None, r[0] or 0)))
    assert sorted(((r.doc_id, r.text) for r in got if r.text is not None), key=str) == want
    assert [r.doc_id for r in got if r.text is None] == [20]


def test_cuckoo_filter_never_misses():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20000))
    made = linededup.CuckooFilter.sized(keys[:15000])
    assert made.has(keys[:15000]).all() and made.has(keys[15000:]).mean() < 0.01
    made.remove(keys[:5000])
    assert made.has(keys[5000:15000]).all() and made.has(keys[:5000]).mean() < 0.01
