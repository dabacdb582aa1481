"""Mixing (op3), top-k (op4), URL filters (op7) and packing (op10) against brute force, with edge cases."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import mixing, packing, topk, urlrules

DOCS = "doc_id bigint, text string, source string, epoch int"


def brute_mix(rows, weights, budget_of):
    out = []
    for source in {r[2] for r in rows}:
        own = [(r[0], len((r[1] or "").split())) for r in rows if r[2] == source]
        total = sum(t for _, t in own)
        if not total:
            continue
        budget = budget_of[source]
        epochs, rest = divmod(budget, total)

        def key(i):
            u = (int(hashlib.md5(f"{mixing.SEED}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / weights.get(i, 0.5)

        run = 0
        for i, t in sorted(own, key=lambda d: (key(d[0]), d[0] or -1)):
            run += t
            out += [(i, source, e + 1) for e in range(epochs + (run <= rest))]
    return Counter(out)


def test_mix_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 60)), ["a", "b", None][i % 3] if i % 5 else "b", 1) for i in range(90)] + [(200, None, "a", 1), (None, "x y", "a", 1), (201, "z " * 5000, "c", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = {i: float(w) for i, w in enumerate(rng.random(40) + 0.1)}
    table = spark.createDataFrame(list(weights.items()) + [(None, 2.0)], "doc_id bigint, weight double")
    totals = {s: sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in {r[2] for r in rows}}
    shares = sum(math.sqrt(t) for t in totals.values())
    budget = {s: math.floor(sum(totals.values()) * math.sqrt(t) / shares) for s, t in totals.items()}
    got = Counter((r.doc_id, r.source, r.epoch) for r in mixing.sample_plan(docs, table).collect())
    assert got == brute_mix(rows, weights, budget)


def test_mixed_documents_are_drawn_by_their_own_weight(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 60)), ["a", "b", None][i % 3] if i % 5 else "b", 1) for i in range(120)] + [(None, "x y", "a", 1), (7, "again " * 9, "c", 1), (201, "z " * 5000, "c", 1)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], DOCS + ", lang string")
    quality = {i: [1, 0, None][int(rng.integers(0, 3))] for i in range(80)}
    labels = spark.createDataFrame(list(quality.items()), "doc_id bigint, quality int")
    weights = {i: {1: 1.0, 0: 0.25, None: 0.5}[q] for i, q in quality.items()}
    totals = {s: sum(len(r[1].split()) for r in rows if r[2] == s) for s in {r[2] for r in rows}}
    shares = sum(math.sqrt(t) for t in totals.values())
    budget = {s: math.floor(sum(totals.values()) * math.sqrt(t) / shares) for s, t in totals.items()}
    want = Counter()
    for (i, source, _), n in brute_mix(rows, weights, budget).items():
        want[i, source] += n
    mixed = mixing.mix_documents(docs, labels)
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == want
    assert {(r.doc_id, r.source, r.text) for r in mixed.collect()} <= {(r[0], r[2], r[1]) for r in rows}


SKEWED = [(i, "w " * 40, f"s{i % 19}", 1) for i in range(950)] + [(2000 + i, "w " * 4, "tiny", 1) for i in range(10)]


def test_skewed_sources_get_their_whole_targets(spark):
    docs = spark.createDataFrame(SKEWED, DOCS)
    none = spark.createDataFrame([], "doc_id bigint, weight double")
    totals = Counter()
    for r in SKEWED:
        totals[r[2]] += len(r[1].split())
    shares = sum(math.sqrt(t) for t in totals.values())
    budget = {s: math.floor(sum(totals.values()) * math.sqrt(t) / shares) for s, t in totals.items()}
    assert budget["tiny"] > 6 * totals["tiny"]
    rows = mixing.sample_plan(docs, none).collect()
    got = Counter()
    for r in rows:
        got[r.source] += r.tokens
    assert all(budget[s] - 40 < got[s] <= budget[s] for s in totals)
    assert Counter((r.doc_id, r.source, r.epoch) for r in rows) == brute_mix(SKEWED, {}, budget)


def test_a_given_cap_hands_the_rest_of_the_budget_on(spark):
    docs = spark.createDataFrame(SKEWED, DOCS)
    none = spark.createDataFrame([], "doc_id bigint, weight double")
    got = Counter()
    for r in mixing.sample_plan(docs, none, targets={"tiny": 1.0, "s0": 1.0}, budget=4000, max_epochs=2).collect():
        got[r.source] += r.tokens
    assert got == {"tiny": 2 * 40, "s0": 4000 - 80}


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1), (1, "a b", "s", 1), (2, "", "s", 1), (3, "c", None, 1)], DOCS)
    none = spark.createDataFrame([], "doc_id bigint, weight double")
    assert mixing.sample_plan(docs.limit(0), none).count() == 0
    got = [(r.doc_id, r.epoch) for r in mixing.sample_plan(docs, none, targets={"s": 1.0}, budget=8).collect()]
    assert Counter(got)[(1, 1)] == 2 and Counter(got)[(1, 2)] == 2 and not [g for g in got if g[0] == 3]
    zero = spark.createDataFrame([(1, 0.0)], "doc_id bigint, weight double")
    assert not [r for r in mixing.sample_plan(docs, zero, targets={"s": 1.0}, budget=3).collect() if r.doc_id == 1]


@pytest.mark.parametrize("scale", [0.0, 1.0])
def test_top_k_equals_brute_force(spark, scale):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 12)) * np.exp(rng.normal(size=(300, 1)) * scale)
    v[5] = v[4]
    v[6] = 0
    df = spark.createDataFrame([(i, list(map(float, x)), "r") for i, x in enumerate(v)], "vec_id bigint, embedding array<double>, rank string")
    got = {(r.vec_id, r.rank): (r.neighbor_id, r.score) for r in topk.top_k(df, 5).collect()}
    product = np.round(v @ v.T, topk.DIGITS)
    np.fill_diagonal(product, -np.inf)
    for i in range(300):
        best = sorted(range(300), key=lambda j: (-product[i, j], j))[:5]
        assert [got[i, k + 1][0] for k in range(5)] == best
    assert len(got) == 1500
    some = {(r.vec_id, r.rank): (r.neighbor_id, r.score) for r in topk.top_k(df, 5, queries=F.col("vec_id") % 50 == 0).collect()}
    assert some == {k: v for k, v in got.items() if k[0] % 50 == 0}


def test_top_k_makes_only_the_pairs_that_can_matter(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 6))
    v[40:] *= 1e-3
    monkeypatch.setattr(topk, "BUCKET", 20)
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(topk, "BROADCAST_BUCKETS", 0)
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    met = []
    real = topk.written
    monkeypatch.setattr(topk, "written", lambda d, label: met.append((label, real(d, label))) or met[-1][1])
    got = {(r.vec_id, r.rank): r.neighbor_id for r in topk.top_k(df, 3).collect()}
    product = np.round(v @ v.T, topk.DIGITS)
    np.fill_diagonal(product, -np.inf)
    for i in range(400):
        best = sorted(range(400), key=lambda j: (-product[i, j], j))[:3]
        assert [got[i, k + 1] for k in range(3)] == best
    floors = dict(met)["topk-floors"].collect()
    assert len(floors) > 1 and all(r.floor >= -1e-6 for r in floors)


def test_top_k_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted((r.vec_id, r.neighbor_id, r.score) for r in topk.top_k(df, 3).collect()) == [(1, 2, 0.5), (2, 1, 0.5)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_url_rules(spark):
    rules = [(1, "ads.example.com/", "block"), (2, "ads.example.com/ok/", "allow"), (3, "example.com/a/b.html?x=1", "block"), (4, "HTTP://U:p@Deep.Example.ORG:80//x/./y/../z/", "block"), (5, None, "block"), (6, "example.net/", "maybe"), (7, "10.0.0.1/", "block"), (8, "example.com/a/", "block"), (9, "example.com/a/", "allow")]
    urls = {
        "http://ads.example.com/page": "block", "https://x.ads.example.com/ok/1": "allow", "http://example.com/a/b.html?x=1": "block",
        "http://example.com/a/b.html?x=2": "allow", "http://q.deep.example.org/x/z/w#f": "block", "http://example.net/": "allow",
        "http://10.0.0.1/x": "block", "http://110.0.0.1/x": "allow", "": "allow", "http:///x": "allow",
    }
    pages = spark.createDataFrame([(u, "v", "e") for u in urls] + [(None, "v", "e")] * 2, "url string, verdict string, _e string")
    table = spark.createDataFrame(rules, "rule_id bigint, pattern string, action string")
    rows = urlrules.filter_urls(pages, table).collect()
    assert {r.url: r.verdict_ for r in rows if r.url is not None} == urls
    assert sum(r.url is None and r.verdict_ == "allow" and r.rule_id is None for r in rows) == 2
    assert urlrules.filter_urls(pages.limit(0), table).count() == 0
    assert {r.verdict_ for r in urlrules.filter_urls(pages, table.limit(0)).collect()} == {"allow"}


def test_deep_rules_are_met(spark):
    rules = [(1, "h.example.com/a/b/c/d/", "block"), (2, "b.c.d.e.f.example.com/", "block"), (3, "example.com/" + "x/" * 40, "block"), (4, "z.b.c.d.e.f.example.com/1/2/3/4/5/6?q", "allow")]
    urls = {"http://h.example.com/a/b/c/d/e": "block", "http://a.b.c.d.e.f.example.com/x": "block", "http://w.example.com/" + "x/" * 41 + "y": "block", "http://w.example.com/" + "x/" * 39: "allow", "http://y.z.b.c.d.e.f.example.com/1/2/3/4/5/6?q": "allow", "http://c.d.e.f.example.com/": "allow"}
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    table = spark.createDataFrame(rules, "rule_id bigint, pattern string, action string")
    assert {r.url: r.verdict for r in urlrules.filter_urls(pages, table).collect()} == urls


def brute_best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        gap = min(fits) if fits else capacity
        if fits:
            gaps.remove(gap)
        gaps.append(gap - s)
    return len(gaps)


def naive_matches(is_piece):
    open_, out = [], [-1] * len(is_piece)
    for k, piece in enumerate(is_piece):
        if not piece:
            open_.append(k)
        elif open_:
            out[k] = open_.pop()
            out[out[k]] = k
    return out


def test_sweep_is_the_matching_of_brackets():
    rng = np.random.default_rng(0)
    for _ in range(400):
        run = rng.random(int(rng.integers(0, 40))) < rng.random()
        want = naive_matches(run)
        assert packing.matched(run).tolist() == want
        # cut into partitions: own matches and those between partitions are those of the whole run
        cuts = np.sort(rng.integers(0, len(run) + 1, 3))
        got, alone, counts = [-1] * len(run), {}, []
        for part, own in enumerate(np.split(np.arange(len(run)), cuts)):
            other = packing.matched(run[own])
            for k, o in zip(own, other, strict=True):
                got[k] = int(own[o]) if o >= 0 else -1
            alone[part] = [own[(other < 0) & run[own]], own[(other < 0) & ~run[own]]]
            counts.append((part, *map(len, alone[part])))
        moves, done = packing.between(counts)
        for part, first, n, s_part, s_rank in moves:
            for k in range(n):
                a, b = alone[part][0][first + k], alone[s_part][1][s_rank - k]
                got[a], got[b] = b, a
        assert got == want and all(done[p] == sum(got[k] >= 0 for k in alone[p][0]) for p in alone)


@pytest.mark.parametrize(("seed", "rows"), [(0, 1 << 17), (1, 40)])
def test_packing_is_near_best_fit(spark, monkeypatch, seed, rows):
    monkeypatch.setattr(packing, "PARTITION_ROWS", rows)
    monkeypatch.setattr(packing, "LEAST_CLASS", 8)
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in np.minimum(64, np.maximum(1, (rng.pareto(1.2, 700) * 6).astype(int)))] + [64] * 20
    items = spark.createDataFrame([(i if i % 50 else None, n) for i, n in enumerate(sizes)], "doc_id bigint, tokens bigint")
    placed = packing.place_pieces(items, 64).collect()
    fill = Counter()
    for r in placed:
        fill[r.seq_id] += r.tokens
    assert Counter(r.tokens for r in placed) == Counter(sizes) and max(fill.values()) <= 64
    assert sorted(fill) == list(range(len(fill)))
    assert len(fill) <= 1.02 * brute_best_fit(sizes, 64) + 1


def test_packing_with_clashing_columns_and_nulls(spark):
    rows = [(1, "a b c", 7, "x", 0.5), (1, "a b c", 7, "x", 0.5), (None, "d e", 8, None, None), (2, None, 9, "y", 1.0), (3, " ", None, "y", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tokens bigint, seq string, gap double")
    (row,) = packing.pack(docs, 64).collect()
    assert (row.tokens, row.doc_ids, row.lengths) == (8, [1, 1, None], [3, 3, 2])


def test_packing_keeps_every_token(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "t " * int(n), "s", 1) for i, n in enumerate(rng.integers(0, 90, 80))] + [(100, None, "s", 1), (101, "", "s", 1), (None, "a b c", "s", 1), (5, "x " * 7, "s", 1), (5, "x " * 7, "s", 1), (102, "long " * 40000, "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    out = packing.pack(docs, 64).collect()
    assert all(r.tokens == sum(r.lengths) <= 64 for r in out) and sorted(r.seq_id for r in out) == list(range(len(out)))
    want, got = Counter(), Counter()
    for i, t, *_ in rows:
        want[i] += len((t or "").split())
    for r in out:
        for i, n in zip(r.doc_ids, r.lengths, strict=True):
            got[i] += n
    assert got == +want
    assert sum(r.tokens for r in out) / (64 * len(out)) > 0.97
    assert packing.pack(docs.limit(0)).count() == 0
