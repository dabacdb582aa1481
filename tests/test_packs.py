"""Links, sidecars, reports, serving tools, the written index and streaming windows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom import catalog_packs
from paperloom.functions import markup, structure, text
from paperloom.operators import chunking, discovery, linkgraph, readiness, retrieval, snapshots
from paperloom.plans import pipeline, serving
from paperloom.session import spread
from paperloom.sources import artifacts, readers, writers
from paperloom.streaming import ingest

WORDS = [f"w{i}" for i in range(40)]
LINKS = "array<struct<href:string,text:string>>"
HEADINGS = "array<struct<level:int,text:string,char_offset:bigint>>"


def site(spark):
    rows = [
        ("a/x.html", "see the Guide and Setup here, Guide again", [("y.html#top", "Guide"), ("../b/index.html", "Setup"), ("/gone.html", "lost"), ("https://o.example/", "out")]),
        ("a/y.html", "back to x, not xx", [("x.html", "x"), ("x.html", "x"), ("y.html", "self")]),
        ("b/index.html", "nothing", []),
    ]
    return spark.createDataFrame([(p, t, t, [], links) for p, t, links in rows], f"path string, raw_text string, text string, headings {HEADINGS}, links {LINKS}")


def test_links_become_edges_sets_and_notes(spark):
    pages = site(spark)
    members = spark.createDataFrame([("a/x.html", 3, 1), ("a/y.html", 3, 2), ("b/index.html", 1, 3)], "path string, words bigint, chunk bigint")
    edges = linkgraph.edges(linkgraph.link_table(pages), members)
    got = {(r.source_path, r.pos): (r.target_path, r.anchor, r.source_chunk, r.target_chunk) for r in edges.collect()}
    assert got == {
        ("a/x.html", 0): ("a/y.html", "#top", 1, 2), ("a/x.html", 1): ("b", "", 1, 3), ("a/x.html", 2): ("/gone.html", "", 1, None),
        ("a/y.html", 0): ("a/x.html", "", 2, 1), ("a/y.html", 1): ("a/x.html", "", 2, 1), ("a/y.html", 2): ("a/y.html", "", 2, 2),
    }
    sets = {r.chunk: (r.references_to, r.referenced_by) for r in linkgraph.reference_sets(edges).collect()}
    assert sets == {1: ([2, 3], [2]), 2: ([1, 2], [1, 2]), 3: ([], [1])}
    assert [(r.target_path, r.links) for r in linkgraph.unresolved(edges).collect()] == [("/gone.html", 1)]
    assert artifacts.cross_reference_totals(edges).first() == (6, 1)
    notes = {r.path: r.text for r in linkgraph.annotated_pages(pages.select("path", "text"), edges).collect()}
    assert notes["a/x.html"] == "see the Guide [-> docs_chunk_02] and Setup [-> docs_chunk_03] here, Guide again"
    assert notes["a/y.html"] == "back to x [-> docs_chunk_01], not xx" and notes["b/index.html"] == "nothing"


def test_pack_plan_names_urls_grades_and_targets(spark):
    manifest = spark.createDataFrame([("a/x.html", None, "https://o.example/x"), ("zz", "a/y.html", "https://o.example/y"), ("yy", "a/y.html", "https://o.example/first")], "key string, local_path string, url string")
    run = pipeline.pack(site(spark), pipeline.PackConfig(max_words=4, context_header=True, cross_refs=True, score=True), manifest=manifest)
    bodies = "\n".join(r.body for r in run.bodies.collect())
    heads = [json.loads(part.split("-->")[0]) for part in bodies.split(f"<!-- {writers.HEADER}")[1:]]
    assert {h["source"]: h.get("url") for h in heads} == {"a/x.html": "https://o.example/x", "a/y.html": "https://o.example/first", "b/index.html": None}
    assert all(set(h["llm_readiness"]) == {"score", "grade", "noise_ratio"} for h in heads) and "[-> docs_chunk_" in bodies
    one = run.summary.first()
    assert (one.files, one.chunks, one.over_words, one.over_chunks) == (3, 3, 2, False)
    dry = pipeline.pack(site(spark).withColumn("text", F.lit("```")), pipeline.PackConfig(dry_run=True, score=True))
    assert dry.bodies is None and all(r.whole for r in dry.scores.collect())
    lost = pipeline.pack(site(spark), pipeline.PackConfig(), overrides=spark.createDataFrame([("a/x.html", "instead")], "path string, text string"))
    assert {r.path: r.text for r in lost.texts.collect()}["a/x.html"] == "instead"


def scores(spark):
    rows = [(1, 100, 90, 3, 2, True), (2, 100, 10, 0, 0, False), (3, 0, 0, 1, 1, True)]
    return readiness.score_rows(spark.createDataFrame(rows, "chunk bigint, raw_words bigint, extracted_words bigint, headings int, max_level int, whole boolean"))


def test_sidecars_hold_state_between_runs(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert artifacts.load_manifest(spark, folder) is None and artifacts.load_readiness(spark, folder) is None
    artifacts.write_readiness(scores(spark), folder)
    snapshot = artifacts.load_readiness(spark, folder)
    assert {r.chunk_id: (r.grade, r.score, r.noise_ratio) for r in snapshot.collect()} == {"docs_chunk_01": ("A", 0.96, 0.1), "docs_chunk_02": ("C", 0.04, 0.9), "docs_chunk_03": ("A", 0.85, 0.0)}
    (tmp_path / "broken.json").write_text("{no json")
    assert artifacts.sidecar(spark, folder, "broken.json", "a int") is None
    later = snapshot.withColumn("score", F.when(F.col("chunk_id") == "docs_chunk_02", 0.6).otherwise(F.col("score"))).withColumn("grade", F.when(F.col("score") == 0.6, "B").otherwise(F.col("grade")))
    text = snapshots.render_drift_text(snapshots.drift(snapshot, later), 0.62, 0.8)
    assert text.splitlines() == ["Drift of the context", "0 added, 1 modified, 0 removed; average 0.62 -> 0.80", "  modified docs_chunk_02  C 0.04 -> B 0.60"]
    diff = spark.createDataFrame([("k1", "added"), ("k2", "removed")], "key string, change string")
    artifacts.write_delta_manifest(diff, spark.createDataFrame([(1, "b"), (1, "a")], "chunk bigint, path string"), folder, "now")
    delta = artifacts.delta_manifest(spark, folder)
    assert {(r.what, r.name, tuple(r.files or ())) for r in delta.collect()} == {("added", "k1", ()), ("removed", "k2", ()), ("chunk", "docs_chunk_01", ("a", "b"))}
    assert snapshots.render_drift_text(snapshots.drift(snapshot, snapshot), 1.0, 1.0, delta=delta).splitlines()[1:] == ["no drift; average 1.00 -> 1.00", "Source files", "  added    k1", "  removed  k2"]


def test_reports_are_worst_first_and_escaped(spark):
    lines = artifacts.terminal_report(scores(spark), "r.html")
    assert [g for g, _ in lines] == [None, "C", "A", "A", None] and "docs_chunk_02: 0.04, loses most by noise" == lines[1][1]
    pages = spark.createDataFrame([("<p>.html", 10, 4, 0, ["<script>alert(1)</script>"], ["fence"])], "path string, raw_words int, extracted_words int, headings int, removed array<string>, issues array<string>")
    html = writers.readiness_html(scores(spark), pages)
    assert html.index(">02<") < html.index(">03<") < html.index(">01<") and "<script>" not in html and "&lt;script&gt;" in html and "&lt;p&gt;.html" in html


def test_chunks_are_listed_and_picked(spark, tmp_path):
    for name in ("docs_chunk_00.md", "docs_chunk_00.jsonl", "docs_chunk_01.txt", "other.md"):
        (tmp_path / name).write_text("x")
    found = artifacts.discover_chunks(spark, f"file://{tmp_path}")
    assert [(r.chunk_id, r.format) for r in found.collect()] == [("docs_chunk_00", "jsonl"), ("docs_chunk_00", "md"), ("docs_chunk_01", "txt")]
    assert [r.format for r in artifacts.pick_chunk(found, "00").collect()] == ["md", "jsonl"]
    with pytest.raises(ValueError):
        artifacts.pick_chunk(found, "07")
    snapshot = spark.createDataFrame([("docs_chunk_01", "B", 0.6)], "chunk_id string, grade string, score double")
    assert {(r.chunk_id, r.format): r.grade for r in artifacts.list_chunks(found, snapshot).collect()}["docs_chunk_01", "txt"] == "B"
    assert artifacts.list_chunks(found).where("grade is null").count() == 3


def test_index_is_written_once_and_searched_exactly(spark, tmp_path):
    rng = np.random.default_rng(0)
    weights = 1 / np.arange(1, 41)
    docs = [(i, " ".join(rng.choice(WORDS, int(rng.integers(0, 30)), p=weights / weights.sum()))) for i in range(150)] + [(200, None), (201, "")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    asked = spark.createDataFrame([(q, " ".join(rng.choice(WORDS, 8))) for q in range(12)] + [(20, "w0 w0 w1"), (21, "unknown"), (22, "")], "query_id bigint, text string")
    index = retrieval.Index.build(table, f"file://{tmp_path}/index")
    loaded = retrieval.Index.load(spark, f"file://{tmp_path}/index")
    for k in (1, 3, 200):
        want = sorted(map(tuple, retrieval.top_k(retrieval.scores(table, asked), k).collect()))
        assert sorted(map(tuple, retrieval.search(table, asked, k).collect())) == want
        assert sorted(map(tuple, retrieval.search(table, asked, k, index=loaded).collect())) == want
    assert index.terms.count() == len({w for _, t in docs for w in (t or "").split()})


def test_ranks_of_expected_documents_are_those_of_a_full_search(spark):
    rng = np.random.default_rng(5)
    weights = 1 / np.arange(1, 41)
    docs = [(i, " ".join(rng.choice(WORDS, int(rng.integers(0, 12)), p=weights / weights.sum()))) for i in range(60)] + [(200, None), (-1, "")]
    asked = [(q, int(rng.integers(0, 60)), " ".join(rng.choice(WORDS, 5))) for q in range(25)] + [(30, -1, "unknown"), (31, 200, "w0"), (32, 0, "unknown"), (33, 3, docs[3][1])]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    questions = spark.createDataFrame(asked, "query_id bigint, expected_id bigint, text string")
    scored = {(r.query_id, r.doc_id): r.score for r in retrieval.scores(table, questions.select("query_id", "text")).collect()}
    for pad in (True, False):
        got = {r.query_id: r["rank"] for r in retrieval.outcomes(table, questions, 4, pad).collect()}
        for q, expected, _ in asked:
            own = {i: scored.get((q, i)) for i, _ in docs}
            order = sorted((i for i in own if pad or own[i] is not None), key=lambda i: (-(own[i] or 0.0), i))[:4]
            assert got[q] == (order.index(expected) + 1 if expected in order else None), (q, pad)


def test_tools_answer_over_a_pack(spark):
    pack = spark.createDataFrame([("01_a.html", "a.html", "the quick fox", ["Intro"], "A"), ("02_b.html", "b.html", "slow turtle", [], "B")], "id string, source string, content string, breadcrumb array<string>, readiness_grade string")
    sets = spark.createDataFrame([("docs_chunk_01", ["docs_chunk_02"])], "chunk_id string, references_to array<string>")
    snapshot = spark.createDataFrame([("docs_chunk_01", 0.9, "A"), ("docs_chunk_02", 0.6, "B")], "chunk_id string, score double, grade string")
    out = []
    server = serving.Server(serving.pack_tools(pack, sets, snapshot))
    ask = lambda name, **args: json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": args}})
    lines = [ask("search_chunks", query="turtle"), "", ask("get_chunk", id="01_a.html"), ask("get_cross_refs", chunk_id="docs_chunk_01"), ask("get_readiness", chunk_id="docs_chunk_02"), ask("get_readiness"), ask("get_chunk", id="nope"), ask("search_chunks", query="x", k=0), ask("search_chunks", query="x", k=True), ask("nothing")]
    server.serve(lines, out.append)
    told = [json.loads(o)["result"] if "result" in json.loads(o) else json.loads(o)["error"] for o in out]
    body = lambda t: json.loads(t["content"][0]["text"])
    assert [(r["id"], r["chunk_id"], r["grade"]) for r in body(told[0])["results"]] == [("02_b.html", "docs_chunk_02", "B")]
    assert body(told[1])["content"] == "the quick fox" and body(told[2])["references_to"] == ["docs_chunk_02"]
    assert body(told[3])["grade"] == "B" and body(told[4])["total_chunks"] == 2
    assert all(t["isError"] for t in told[5:8]) and told[8]["code"] == serving.BAD_PARAMS


@pytest.mark.parametrize(("asked", "answered"), [("2024-11-05", "2024-11-05"), ("1999-01-01", serving.PROTOCOL), (7, serving.PROTOCOL), (None, serving.PROTOCOL)])
def test_unknown_protocol_versions_get_the_own_one(asked, answered):
    params = {} if asked is None else {"protocolVersion": asked}
    reply = serving.Server([]).handle({"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": params})
    assert json.loads(reply)["result"]["protocolVersion"] == answered


def test_a_page_that_fails_is_null(spark, monkeypatch):
    import pyarrow as pa

    def fails(html):
        raise ValueError(html)

    monkeypatch.setattr(markup, "events", fails)
    assert markup._page(pa.array(["<p>x</p>", None])).to_pylist() == [None, None]


def test_balance_reads_one_block_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(chunking, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    words = [int(x) for x in rng.integers(1, 90, 100)]
    rows = [(f"f{i:03d}", w, i // 5) for i, w in enumerate(words)]
    got = {r.path: r.chunk for r in chunking.balance(spark.createDataFrame(rows, "path string, words bigint, chunk bigint"), 7, 700).collect()}
    goal, chunk, run, want = sum(words) // 7, 1, 0, {}
    for path, w, _ in rows:
        if run and chunk < 7 and (run >= goal or run + w > 700):
            chunk, run = chunk + 1, 0
        run += w
        want[path] = chunk
    assert got == want


def test_sub_chunks_as_a_table_function(spark):
    spark.udtf.register("subchunks", structure.SubchunkRows)
    body = "one two three\n\nfour five\n\nsix"
    rows = spark.sql("SELECT piece, char_offset, text FROM VALUES ('%s') t(body), LATERAL subchunks(body, 4)" % body).collect()
    assert [tuple(r) for r in rows] == [(0, 0, "one two three"), (1, 15, "four five\n\nsix")]
    assert [(r.char_offset, r.text) for r in rows] == [(o, t) for t, o in structure.split_by_words(body, 4)]


def test_boundary_faults_as_a_column(spark):
    texts = ["ok", None, "```\ncode\n```\n\n```", "<pre>a</pre>\n</pre>"]
    got = [[tuple(i) for i in r.i] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(structure.issues(F.col("t")).alias("i")).collect()]
    assert got == [[], [], [("code_fence", 5, "```")], [("pre_tag", 2, "</pre>")]]


def test_crawl_frontier(spark):
    at = "https://d.example/"
    pages = spark.createDataFrame([(at, [at + "a#x", at + "b", "https://o.example/"]), (at + "a", [at + "c", at]), (at + "b", [at + "gone"]), (at + "c", [at + "d"]), (at + "d", [])], "url string, targets array<string>")
    assert {r.url: r.level for r in discovery.frontier_crawl(pages, at, at, 2).collect()} == {at: 0, at + "a": 1, at + "b": 1, at + "c": 2}


def test_manifest_and_readiness_of_one_file(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"base_url": "b", "last_run": "t", "files": {"a.md": {"url": "u", "size_bytes": 3, "odd": 1}}}))
    assert [(r.key, r.url, r.size_bytes) for r in readers.manifest(spark, f"{tmp_path}/m.json").collect()] == [("a.md", "u", 3)]
    assert readers.manifest(spark, f"{tmp_path}/none.json") is None
    (tmp_path / "r.json").write_text(json.dumps({"chunks": [{"chunk_id": "c", "score": 0.5, "grade": "B"}, {"chunk_id": "c", "score": 0.9, "grade": "A"}]}))
    assert [(r.chunk_id, r.score) for r in readers.readiness(spark, f"{tmp_path}/r.json").collect()] == [("c", 0.9)]


def test_windows_of_a_stream(spark, tmp_path):
    rows = [("2026-01-01 10:05:00", "a", 1), ("2026-01-01 10:50:00", "a", 2), ("2026-01-01 11:10:00", "b", 1)]
    spark.createDataFrame(rows, "ts string, event_type string, user_id bigint").select(F.to_timestamp("ts").alias("ts"), "event_type", "user_id").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string, user_id bigint").parquet(f"{tmp_path}/in")
    query = ingest.change_windows(stream).writeStream.format("memory").queryName("change_windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.start.hour, r.event_type, r.events) for r in spark.table("change_windows").collect()) == [(10, "a", 2), (11, "b", 1)]


def test_scratch_removes_what_was_written_in_it(spark):
    import os

    from paperloom.session import scratch, shared_root, written

    root = shared_root(spark).removeprefix("file:")
    kept = written(spark.range(3), "kept")
    before = set(os.listdir(root))
    with scratch(spark):
        assert written(spark.range(5), "gone").count() == 5 and set(os.listdir(root)) > before
    assert set(os.listdir(root)) == before and kept.count() == 3


def test_small_inputs_are_spread(spark):
    one = spark.range(10).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 10, 1, 64)).rdd.getNumPartitions() == 64


def test_files_and_queries_are_read(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("some words")
    (tmp_path / "d" / "p.html").write_text("<main><h1>T</h1><p>in page</p></main>")
    (tmp_path / "d" / "i.png").write_text("x")
    (tmp_path / "q.txt").write_text("# no\n\n install  \nrun it\n")
    held = {r.path: r.text for r in readers.texts(readers.files(spark, f"{tmp_path}/d")).collect()}
    assert held["a.md"] == "some words" and "in page" in held["p.html"] and "i.png" not in held
    assert [r.text for r in readers.query_lines(spark, f"{tmp_path}/q.txt").orderBy("query_id").collect()] == ["install", "run it"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_vocabularies_are_read_from_a_path(spark, name):
    import os

    from paperloom.functions import tokens

    path = os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), name)
    if not os.path.exists(path):
        pytest.skip("no vocabularies here")
    texts = ["hello world", "", None, "<|endoftext|> and more " * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    count = tokens.file_counter(path)()
    assert [r.n for r in rows.select(tokens.token_count(F.col("t"), tokens.file_counter(path)).alias("n")).collect()] == [0 if t is None else count(t) for t in texts]
    assert 2 <= count("hello world") <= 6
    with pytest.raises(ValueError):
        tokens.file_counter("vocabulary.txt")
    with pytest.raises(ValueError):
        tokens.tiktoken_counter("no such encoding")


@pytest.fixture(scope="module")
def pages_folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("pages"))
    body = "<title>{0}</title><body><nav><ul>{1}</ul></nav><article><h1>{0}</h1><p>{0}</p></article></body>"
    rows = [
        (0, "https://a.example/x/0", body.format("a&amp;&amp;&amp", "")), (1, "https://a.example/y/1", body.format("AT&T &amp;lt; &copy &copy; &nosuch;", "")),
        (2, "https://a.example/y/2", body.format("t", "<li>w</li>" * 80)), (3, "https://a.example/y/3", body.format("word " * 30, "")), (4, "https://a.example/y/4", None),
    ]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{out}/pages.parquet")
    return out


def against_sql(spark, name, folder):
    """The rows of a query and those of its SQL."""
    import duckdb

    got = catalog_packs.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog_packs.ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)


@pytest.mark.parametrize("name", ["spa_shells", "html_heading_texts", "html_text", "main_content", "import_guide"])
def test_cut_references_and_short_pages_are_those_of_the_sql(spark, pages_folder, name):
    got, want = against_sql(spark, name, pages_folder)
    assert got == want and got


def test_ampersands_that_begin_no_reference_stay_everywhere():
    page = markup.events("<p title='a&ampb&lt;'>x &amp y</p><xmp>&amp; &</xmp><a href='?a=1&b=2&copy=3&amp;d'>t</a>")
    assert [e.attrs for e in page if e.attrs] == [{"title": "a&ampb<"}, {"href": "?a=1&b=2&copy=3&d"}]
    assert markup.plain(page).startswith("x &amp y") and markup.anchors(page) == [{"href": "?a=1&b=2&copy=3&d", "text": "t"}]


def test_a_worker_holds_the_views_of_few_pages(spark, monkeypatch):
    import pyarrow as pa

    held, real = [], markup._views
    monkeypatch.setattr(markup, "_views", lambda c: held.append(len(c)) or real(c))
    assert len(markup._page(pa.array([f"<p>{i}</p>" for i in range(200)]))) == 200 and max(held) <= 64
    pages = spark.range(150).select(F.format_string("<h1>t%d</h1><a href='x'>l</a>", "id").alias("html"), "id").coalesce(1).unionByName(spark.createDataFrame([(None, 900)], "html string, id bigint"))
    by_column = pages.select("html", "id", markup.parse_page(F.col("html")).alias("v")).select("html", "id", "v.*")
    monkeypatch.undo()
    whole = markup.parsed(pages)
    assert whole.columns == by_column.columns and sorted(whole.collect(), key=lambda r: r.id) == sorted(by_column.collect(), key=lambda r: r.id)
    sizes = whole.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint")
    assert whole.count() == 151 and sizes.count() >= 1


@pytest.mark.parametrize("order", ["numbered", "chunk_by_size"])
def test_an_ordered_input_is_made_once_in_its_own_partitions(spark, order):
    from pyspark import TaskContext

    rows = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def task(i):
        rows.add(1)
        return TaskContext.get().partitionId()

    made = spark.range(0, 40, 1, 4).select(F.format_string("p%02d", "id").alias("path"), task("id").cast("bigint").alias("words"))
    out = (chunking.numbered(made, ["path"], "n") if order == "numbered" else chunking.chunk_by_size(made, 5)).collect()
    assert len(out) == 40 and {r.words for r in out} == {0, 1, 2, 3} and rows.value == 40


@pytest.mark.parametrize("of", [text.word_count, text.line_words, text.normalize, text.split_blocks, text.long_blocks])
def test_words_and_blocks_need_no_regular_expression(spark, of):
    df = spark.createDataFrame([(" A\u00a0b\n\n c \u2003 d\x1c e ",), (None,), ("",)], "t string").select(of(F.col("t")).alias("x"))
    assert "regexp" not in df._jdf.queryExecution().executedPlan().toString().lower()
    want = {"word_count": [5, 0, 0], "line_words": [[2, 3], [], []], "normalize": ["a b c d e", None, ""], "split_blocks": [["A\u00a0b", "c \u2003 d\x1c e"], None, []], "long_blocks": [[], None, []]}
    assert [r.x for r in df.collect()] == want[of.__name__]


def test_marks_are_counted_with_and_without_tags(spark):
    texts = ["``` ```` ```", "<PRE >``` </pre> <pre>", "<pr", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*(m.alias(n) for m, n in zip(structure.marks(F.col("t")), "abc", strict=True)), structure.intact(F.col("t")).alias("d")).collect()
    assert list(map(tuple, rows)) == [(3, 0, 0, False), (1, 2, 1, False), (0, 0, 0, True), (0, 0, 0, True), (None, None, None, None)]


def test_tables_that_grow_are_never_broadcast(spark, monkeypatch):
    """Neither in the plans of the results nor in those of the tables written for them."""
    from paperloom.operators import blockdedup

    plans, plan_of = [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (blockdedup, chunking, pipeline):
        monkeypatch.setattr(module, "written", lambda df, label, real=module.written: plans.append(plan_of(df)) or real(df, label))
    pages = site(spark).withColumn("text", F.concat("text", F.lit("\n\n" + " ".join(WORDS))))
    run = pipeline.pack(pages, pipeline.PackConfig.preset("rag", strategy="semantic", max_words=50))
    plans += [plan_of(df) for df in (run.pieces, run.members, run.scores)]
    assert len(plans) > 15 and not [p for p in plans if "BroadcastHashJoin" in p]


def test_texts_are_tokenised_once_for_scores_and_index(spark, monkeypatch):
    """The statistics and the postings come from one table of counts, which nothing with a regular expression of the JVM makes."""
    made, real = [], retrieval.written
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(retrieval, "written", lambda df, label: made.append((label, plan_of(df))) or real(df, label))
    docs = spark.createDataFrame([(0, "A b b é1"), (1, None), (2, "")], "doc_id bigint, text string")
    retrieval.scores(docs, spark.createDataFrame([(7, "b 1")], "query_id bigint, text string"))
    retrieval.Index.build(docs)
    assert [label for label, _ in made].count("term-counts") == 2
    assert not [p for label, p in made if label not in ("query-terms", "query-weights") and "regexp" in p.lower()]
    rows = {r.doc_id: (r.dl, {(t.term, t.tf) for t in r.terms}) for r in retrieval.counted(docs).collect()}
    assert rows == {0: (4, {("a", 1), ("b", 2), ("1", 1)}), 1: (0, set()), 2: (0, set())}


def test_documents_above_are_counted_with_ties_and_tiny_scores():
    import pandas as pd

    docs = pd.DataFrame({"doc_id": ["a", "b", "c", "d"], "t": [1, 1, 1, 2], "part": [2.0, 1.0, 1.0, 1e-9]})
    asked = pd.DataFrame({"query_id": [1, 2, 3, 4], "expected_id": ["c", "b", "d", "zz"], "own": [1.0, 1.0, 0.0, 5.0], "t": [1, 1, 2, 9], "weight": [1.0, 1.0 + 4e-7, 1.0, 1.0]})
    assert retrieval._above(docs, asked)["above"].tolist() == [2, 1, 0, 0]
    assert retrieval._rounded(0.1234565) == 0.123457 and retrieval._rounded(2.5e-7) == 0.0
