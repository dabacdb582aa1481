"""The pipeline's stages against what they stand for, on a small folder of tables."""

import numpy as np
import pytest

import corpus_pipeline
from paperloom.llm import packing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    words = [f"word{i}" for i in range(300)]
    prose = lambda: " ".join(rng.choice(words, 60)) + "."
    texts = [prose() if i % 4 else "$$$ 100% !!! " * 12 for i in range(200)]
    texts[9] = texts[5]
    texts[10] = texts[6] + " tail"
    shared = "this very line stands in many of the documents"
    texts = [t + ("\n" + shared if i % 2 else "") for i, t in enumerate(texts)]
    out = tmp_path_factory.mktemp("sf")
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)], "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), texts, shared


def test_stages(spark, folder, tmp_path):
    sf_dir, texts, shared = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        held[name] = docs
        if name != "pack":
            assert docs.columns == columns
    kept = {r.doc_id for r in held["quality"].collect()}
    assert np.mean([(i in kept) == bool(i % 4) for i in range(200)]) > 0.95
    lines = {r.doc_id: r for r in held["lines"].collect()}
    assert sum(shared in r.text for r in lines.values()) == 1
    assert all(r.n_chars == len(r.text) for r in lines.values())
    near = {r.doc_id for r in held["near_duplicates"].collect()}
    assert 10 not in near and 6 in near and len(near) == len(lines) - 1
    mixed = {}
    for r in held["mix"].collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + len(r.text.split())
    packed = {}
    for r in held["pack"].collect():
        assert r.tokens <= packing.CAPACITY
        for i, n in zip(r.doc_ids, r.lengths, strict=True):
            packed[i] = packed.get(i, 0) + n
    assert packed == mixed and set(mixed) <= near


def test_run_is_the_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).columns == ["seq_id", "tokens", "doc_ids", "starts", "lengths"]


def odd_rows(spark, folder):
    long_ = "a very long text of many words " * 20000
    rows = [
        (1, None, "en", "s0", None, "x", 1), (2, "", None, "s0", 0, "x", 2), (3, " \n ", "en", None, 3, None, 3), (None, folder[1][1], "en", "s1", 5, "x", 4),
        (4, folder[1][2], "en", "s1", 5, "x", 5), (4, folder[1][2], "en", "s1", 5, "x", 5), (5, folder[1][2], "en", "s1", 5, "y", 6), (6, long_, "en", "s2", 7, "x", 7),
        (7, folder[1][3], None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, weight string, pos int")


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_each_stage_takes_odd_rows_and_empty_tables(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd_rows(spark, folder)
    if name == "quality":  # with documents to learn from
        docs = docs.unionByName(spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id >= 10"), allowMissingColumns=True)
    got, none = stage(spark, docs, folder[0]), stage(spark, docs.limit(0), folder[0])
    assert none.count() == 0 and none.columns == got.columns
    rows = got.collect()
    ids = [r.doc_id for r in rows] if name != "pack" else []
    if name != "pack":
        assert got.columns == docs.columns
        assert {(r.doc_id, r.pos) for r in rows} <= {(r.doc_id, r.pos) for r in docs.collect()}
    if name == "quality":
        assert not {1, 2, 3} & set(ids) and None in ids and ids.count(4) == 2
    if name == "lines":  # the repeated row and the odd documents that have only lines of even ones go
        assert sorted(ids, key=str) == sorted([1, 2, 3, None, 4, 6, 7], key=str)
        assert {r.doc_id: r.n_chars for r in rows}[1] is None and {r.doc_id: r.text for r in rows}[3] == " \n "
    if name == "near_duplicates":
        assert sorted(ids, key=str) == sorted([1, 2, 3, None, 4, 4, 6, 7], key=str)
    if name == "mix":
        assert set(ids) <= {1, 2, 3, None, 4, 5, 6, 7} and ids.count(4) % 2 == 0
        own = [(r.source, len((r.text or "").split())) for r in docs.collect()]
        totals = {s: sum(n for t, n in own if t == s) for s, _ in own}
        shares = sum(t**0.5 for t in totals.values())
        for source, total in totals.items():
            budget = sum(totals.values()) * total**0.5 / shares
            assert sum(len((r.text or "").split()) for r in rows if r.source == source) <= budget
    if name == "pack":
        held = {}
        for r in rows:
            for i, n in zip(r.doc_ids, r.lengths, strict=True):
                held[i] = held.get(i, 0) + n
        want = {}
        for r in docs.collect():
            want[r.doc_id] = want.get(r.doc_id, 0) + len((r.text or "").split())
        assert held == {i: n for i, n in want.items() if n}


def test_lines_stage_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    seen, want = set(), {}
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id % 2, r.doc_id)):
        own = r.text.split("\n")
        kept = []
        for line in own:
            if len(line.strip(" ")) >= 20 and line.strip(" ") in seen:
                continue
            seen.add(line.strip(" "))
            kept.append(line)
        if len(kept) == len(own) or "\n".join(kept).strip():
            want[r.doc_id] = "\n".join(kept)
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, folder[0]).collect()} == want
