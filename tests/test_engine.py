"""The engine's own operators: literal cases, brute force, partition invariance."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import markup, structure, text
from paperloom.operators import blockdedup, chunking, discovery, readiness, retrieval, snapshots
from paperloom.plans.pipeline import PackConfig, pack
from paperloom.plans.serving import Server, Tool, ToolError
from paperloom.sources import readers, writers


def test_words_as_python_splits_them(spark):
    rows = ["", " a  b c d　e\x1cf\x85g ", "one", None, "\n\t "]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(text.word_count(F.col("t")).alias("n")).collect()]
    assert got == [len((t or "").split()) for t in rows]


def greedy(prints, t):
    kept, gone = [], set()
    for i, p in enumerate(prints):
        if any(bin((p ^ q) & (2**64 - 1)).count("1") <= t for q in kept):
            gone.add(i)
        else:
            kept.append(p)
    return gone


@pytest.mark.parametrize("threshold", [0, 3, 8])
def test_leaders_equal_sequential_greedy(spark, threshold):
    rng = np.random.default_rng(threshold)
    prints = []
    for _ in range(25):
        p = int(rng.integers(-(2**62), 2**62))
        for _ in range(6):
            prints.append(p)
            p ^= 1 << int(rng.integers(0, 62))
            p ^= 1 << int(rng.integers(0, 62))
    prints = list(dict.fromkeys(prints))
    nodes = spark.createDataFrame([(p, ("x", i)) for i, p in enumerate(prints)], "fp bigint, place struct<path:string,pos:int>").cache()
    state = {r.fp: r.stays for r in blockdedup.leaders(nodes, blockdedup.similar_pairs(nodes, threshold)).collect()}
    assert {i for i, p in enumerate(prints) if not state[p]} == greedy(prints, threshold)


def test_key_plan_misses_no_pair():
    for n in (10, 10**5, 10**9):
        plan = blockdedup.key_plan(3, n)
        rng = np.random.default_rng(n)
        for _ in range(50):
            flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(all(not (flips >> s) & ((1 << b) - 1) for s, b in cells) for cells in plan)


def test_dedup_modes(spark):
    long_ = "the installation guide for version {} explains how to set up and configure the main application server properly today"
    docs = spark.createDataFrame([("a.txt", long_.format("2.0") + "\n\nshort one"), ("b.txt", long_.format("2.0") + "\n\nshort one"), ("c.txt", None), ("d.txt", long_.format("3.0"))], "path string, text string")
    exact = {r.path: r.text for r in blockdedup.deduplicate(docs, "exact").collect()}
    assert exact["b.txt"] == "short one" and exact["d.txt"] and exact["c.txt"] is None
    both = {r.path: r.text for r in blockdedup.deduplicate(docs, "both", 10).collect()}
    assert both["d.txt"] == "" and both["a.txt"].startswith("the installation")
    with pytest.raises(ValueError):
        blockdedup.removed_blocks(docs, "other")


def next_fit(words, limit):
    out, chunk, run = [], 0, -1
    for w in words:
        if run < 0 or run + w > limit:
            chunk, run = chunk + 1, 0
        run = -1 if w > limit else run + w
        out.append(chunk)
    return out


@pytest.mark.parametrize("block", [7, 40, 10_000])
def test_parallel_next_fit_is_the_fold(spark, monkeypatch, block):
    monkeypatch.setattr(chunking, "BLOCK_ROWS", block)
    rng = np.random.default_rng(block)
    words = [int(w) for w in np.where(rng.random(150) < 0.1, rng.integers(90, 300, 150), np.where(rng.random(150) < 0.3, 0, rng.integers(1, 60, 150)))]
    files = spark.createDataFrame([(f"f{i:04d}", w) for i, w in enumerate(words)], "path string, words bigint").repartition(5)
    got = [r.chunk for r in chunking.chunk_by_size(files, 100).orderBy("path").collect()]
    assert got == next_fit(words, 100)


def by_directory(files, limit):
    groups, chunks, current, run = {}, [], [], 0
    for p, w in files:
        groups.setdefault(p.rsplit("/", 1)[0] if "/" in p else "_", []).append((p, w))
    for g in sorted(groups):
        own = sorted(groups[g])
        total = sum(w for _, w in own)
        if total <= limit:
            if run + total > limit and current:
                chunks.append(current)
                current, run = [], 0
            current, run = current + [p for p, _ in own], run + total
        else:
            if current:
                chunks.append(current)
            current, run = [], 0
            inner = next_fit([w for _, w in own], limit)
            chunks += [[p for (p, _), c in zip(own, inner, strict=True) if c == k] for k in range(1, inner[-1] + 1)]
    return {p: i for i, c in enumerate([*chunks, *([current] if current else [])], 1) for p in c}


def balanced(words, target, limit):
    if len(words) <= target:
        return list(range(1, len(words) + 1))
    goal, out, chunk, run, held, left = sum(words) // target, [], 1, 0, 0, len(words)
    for w in words:
        left -= 1
        budget = target - chunk
        if held and run + w > limit and budget > 0:
            chunk, run, held, budget = chunk + 1, 0, 0, budget - 1
        out.append(chunk)
        run, held = run + w, held + 1
        if run >= goal and budget > 0 and left > 0:
            chunk, run, held = chunk + 1, 0, 0
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_directories_and_balance(spark, seed):
    rng = np.random.default_rng(seed)
    files = [(f"d{int(rng.integers(0, 12)):02d}/f{i:03d}" if i % 9 else f"root{i:03d}", int(rng.integers(0, 50))) for i in range(120)]
    df = spark.createDataFrame(files, "path string, words bigint")
    got = {r.path: r.chunk for r in chunking.chunk_by_directory(df, 200).collect()}
    assert got == by_directory(files, 200)
    order = sorted(files, key=lambda f: f[0])
    flat = df.withColumn("chunk", F.lit(1).cast("bigint"))
    for target, limit in ((7, 10_000), (7, 150), (200, 100)):
        out = {r.path: r.chunk for r in chunking.balance(flat, target, limit).collect()}
        assert [out[p] for p, _ in order] == balanced([w for _, w in order], target, limit)


PAGE = "<html><body><nav>menu</nav><main><h1>Title</h1><p>Some &lt;b&gt; text</p><div class='docs-sidebar'>gone<div>too</div></div><img class='sidebar'><p>More <a href='x.html#y'>link</a></p></main><script>var a</script></body></html>"


def test_page_views():
    page = markup.events(PAGE)
    main = markup.main_part(page)
    assert markup.plain(main) == "Title\n\nSome <b> text\n\nMore link"
    assert "menu" in markup.plain(page) and "var a" not in markup.plain(page)
    assert [(h["level"], h["text"]) for h in markup.outline(main)[1]] == [(1, "Title")]
    assert markup.anchors(page) == [{"href": "x.html#y", "text": "link"}]
    assert markup.main_part(markup.events("<article>a</article><main>b</main>"))[0].name == "b"
    assert markup.plain(markup.main_part(markup.events("<main>never closed <p>text</p>"))) == "never closed text"
    dense = "<div id='x'>" + "word " * 60 + "</div><div>" + "<a>l</a>" * 40 + "</div>"
    assert markup.plain(markup.main_part(markup.events(dense))).split() == ["word"] * 60
    assert markup.plain(markup.main_part(markup.events("<p>a</p><aside>x<p>b</p>"))) == "a"
    assert markup.events(None) == [] == markup.events("  ")


def test_structure():
    assert structure.structural_blocks(["```py", "a", "```", "- x", "2. y", "p", "| a |", "| b |", "<pre>", "z", "</pre>"]) == ["```py\n\na\n\n```", "- x\n\n2. y", "p", "| a |\n\n| b |", "<pre>\n\nz\n\n</pre>"]
    assert structure.split_by_words("", 5) == [("", 0)] and structure.split_by_words("a b", 0) == [("a b", 0)]
    assert structure.split_by_words("a b\n\nc d\n\ne", 3) == [("a b", 0), ("c d\n\ne", 5)]
    issues = structure.boundary_issues("x\n```\ny <pre>\n")
    assert [(i["kind"], i["line"]) for i in issues] == [("code_fence", 2), ("pre_tag", 3)]


def test_ignore_rules(spark):
    paths = ["a.log", "keep/a.log", "build/x.txt", "src/build/y.txt", "docs/a.md", "docs/deep/b.md", "x.PNG", "a/q/b.txt", "im[1].txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    left = lambda *p: {r.path for r in discovery.filter_files(df, list(p)).collect()}
    assert left("*.log", "!keep/*.log", "# note", "") == set(paths) - {"a.log", "x.PNG"}
    assert left("/build/") == set(paths) - {"build/x.txt", "x.PNG"}
    assert left("docs/*.md", "a/**/b.txt") == set(paths) - {"docs/a.md", "a/q/b.txt", "x.PNG"}


def test_url_scope(spark):
    urls = ["https://h.x/docs", "https://h.x/docsextra", "http://h.x/docs/a/b", "https://h.x/docs/a/b/c", "ftp://h.x/docs/a", "https://o.x/docs/a", "https://h.x/docs"]
    df = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, pos int")
    assert {(r.url, r.pos) for r in discovery.filter_urls(df, "https://h.x/docs/", 2).collect()} == {(urls[0], 0), (urls[2], 2)}


def test_retrieval(spark):
    docs = spark.createDataFrame([("a", "install pip now"), ("b", "pip pip"), ("c", "zebra"), ("d", None)], "doc_id string, text string")
    queries = spark.createDataFrame([(0, "pip install"), (1, "pip"), (2, "nothing")], "query_id int, text string")
    best = [(r.query_id, r.rank, r.doc_id) for r in retrieval.search(docs, queries, 2).orderBy("query_id", "rank").collect()]
    assert best == [(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "a")]
    padded = retrieval.search(docs, queries, 2, pad=True)
    assert [(r.doc_id, r.score) for r in padded.where("query_id = 2").orderBy("rank").collect()] == [("a", 0.0), ("b", 0.0)]
    assert [r.doc_id for r in retrieval.query_order(docs, queries).orderBy("seq").collect()] == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        retrieval.top_k(retrieval.scores(docs, queries), True)


def test_drift_vector(spark):
    kind = "chunk_id string, score double, grade string"
    old = spark.createDataFrame([("01", 9.0, "A"), ("02", 7.0, "B"), ("04", 6.0, "C")], kind)
    new = spark.createDataFrame([("01", 9.0, "A"), ("02", 8.5, "A"), ("03", 8.0, "A")], kind)
    row = snapshots.drift_summary(old, new).first()
    assert (row.added, row.modified, row.removed, row.has_drift) == (1, 1, 1, True) and round(row.old_avg, 2) == 7.33 and row.new_avg == 8.5
    body = snapshots.render_drift(snapshots.drift(old, new), row.old_avg, row.new_avg)
    assert "`02`: B → A, 7.00 → 8.50 (+1.50)" in body
    assert snapshots.drift_summary(None, new).first().has_drift


def test_scores(spark):
    rows = spark.createDataFrame([(1000, 900, 3, 2, True), (0, 0, 0, 0, False), (100, 40, 1, 1, True)], "raw_words int, extracted_words int, headings int, max_level int, whole boolean")
    assert [(round(r.score, 2), r.grade) for r in readiness.score_rows(rows).orderBy(F.desc("score")).collect()] == [(0.96, "A"), (0.61, "B"), (0.4, "C")]


def test_pack_plan_and_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(f"d/p{i}.html", PAGE.replace("Title", f"Title {i}")) for i in range(4)], "path string, html string")
    v = pages.select("path", markup.parse_page(F.col("html")).alias("v")).select("path", F.col("v.raw_text").alias("raw_text"), F.col("v.main_text").alias("text"), F.col("v.headings").alias("headings"), F.col("v.links").alias("links"))
    run = pack(v, PackConfig.preset("rag", max_words=14))
    records = [json.loads(r.record) for r in writers.jsonl_records(run.pieces, grades=run.scores).orderBy("path").collect()]
    assert [r["source"] for r in records] == [f"d/p{i}.html" for i in range(4)] and records[0]["breadcrumb"] == ["Title 0"]
    assert "url" not in records[0] and records[0]["readiness_grade"] in "ABC"
    out = tmp_path / "docs_chunk_01.jsonl"
    out.write_text("\n".join(map(json.dumps, records)) + "\nbroken {\n\n[1]\n")
    assert readers.pack(spark, str(tmp_path)).count() == 4
    body = pack(v, PackConfig(max_words=14, context_header=True)).bodies
    cut = body.select(F.explode(writers.sections(F.col("body"))).alias("s")).select("s.*").orderBy("source").collect()
    assert [c.source for c in cut] == [f"d/p{i}.html" for i in range(4)] and cut[0].breadcrumb == ["Title 0"]


def test_configuration():
    assert PackConfig.resolve({"max_words": 5}, {"max-words-per-chunk": 9, "strategy": "semantic", "odd": 1}) == PackConfig(max_words=5, strategy="semantic")
    assert PackConfig(report=True).validated().score
    for bad in (PackConfig(format="xml"), PackConfig(report=True, dry_run=True)):
        with pytest.raises(ValueError):
            bad.validated()
    with pytest.raises(ValueError):
        PackConfig(strategy="semantic").validated(queries=True)


def test_server_survives():
    def fail(args):
        raise ToolError("told") if args else RuntimeError("broken")

    server = Server([Tool("t", "", {}, fail)])
    call = lambda args: json.loads(server.handle({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "t", "arguments": args}}))
    assert call({"a": 1})["result"]["isError"] and call({})["error"]["code"] == -32603
    assert json.loads(server.handle_line("{"))["error"]["code"] == -32700
    assert server.handle({"jsonrpc": "2.0", "method": "ping"}) is None
    assert json.loads(server.handle({"jsonrpc": "2.0", "id": 2, "method": "no"}))["error"]["code"] == -32601


def test_stream_of_blocks(spark, tmp_path):
    from paperloom.streaming.ingest import ingest

    line = "one block that has more than ten words in it so it counts"
    spark.createDataFrame([("a", line), ("b", line + "\n\nshort"), ("c", "short")], "path string, text string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, text string, ts timestamp").parquet(f"{tmp_path}/in")
    ingest(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(r.block for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [line, "short", "short"]
