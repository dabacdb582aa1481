"""Registered queries of readers, writers, sidecars, summaries, serving and streaming; with :mod:`paperloom.catalog`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.catalog import _ASSIGN, _FACTS, _HOST, _NEXT_FIT, _SNAP, _docs, _edges, _LINKED, _questions, _scored, _searchable, _snapshots, _words, MAX_WORDS, ORACLE_SQL, QUERIES, query
from paperloom.functions import text
from paperloom.operators import chunking, discovery, linkgraph, retrieval, snapshots
from paperloom.plans import pipeline, serving
from paperloom.session import new_folder
from paperloom.sources import artifacts, readers, writers
from paperloom.streaming import ingest

PACK_WORDS = 5_000
__all__ = ["ORACLE_SQL", "QUERIES"]  # those of both modules


def _folder(spark: SparkSession, label: str) -> str:
    return new_folder(spark, label)


def _text_pages(spark: SparkSession, d: str) -> DataFrame:
    """The documents as pages without markup, headings or links."""
    none = "array<struct<level:int,text:string,char_offset:bigint>>"
    docs = _docs(spark, d)
    return docs.select("path", F.col("text").alias("raw_text"), "text", F.array().cast(none).alias("headings"), F.array().cast("array<struct<href:string,text:string>>").alias("links"))


def _urls(spark: SparkSession, d: str) -> DataFrame:
    """A manifest for every third document, half of it by local path and half by key."""
    docs = _docs(spark, d).where("doc_id % 3 = 0")
    by_path = F.col("doc_id") % 2 == 0
    return docs.select(F.when(by_path, F.concat(F.lit("k"), F.col("doc_id").cast("string"))).otherwise(F.col("path")).alias("key"), F.when(by_path, F.col("path")).alias("local_path"), F.concat(F.lit("https://site.example/"), "path").alias("url"))


def _packed(spark: SparkSession, d: str, **config) -> pipeline.Packed:
    return pipeline.pack(_text_pages(spark, d), pipeline.PackConfig(max_words=PACK_WORDS, **config), manifest=_urls(spark, d))


_FOLD = _NEXT_FIT.replace(str(MAX_WORDS), str(PACK_WORDS))
_RECORDS = f"""{_FOLD}, records AS (SELECT printf('%02d_%s', chunk, f.path) AS id, f.path AS source, f.words, coalesce(text, '') AS content, chunk, doc_id,
    CASE WHEN doc_id % 3 = 0 THEN 'https://site.example/' || f.path END AS url FROM fold f JOIN files USING (path))"""
_RECORD_JSON = """'{"id":' || to_json(id)::VARCHAR || ',"source":' || to_json(source)::VARCHAR || ',"words":' || words || ',"content":' || to_json(content)::VARCHAR || ',"schema_version":"v1"' || CASE WHEN url IS NULL THEN '' ELSE ',"url":' || to_json(url)::VARCHAR END || '}'"""


@query(f"WITH RECURSIVE {_RECORDS} SELECT source AS path, {_RECORD_JSON} AS record FROM records")
def jsonl_documents(spark: SparkSession, d: str) -> DataFrame:
    run = _packed(spark, d, format="jsonl")
    return writers.jsonl_records(run.pieces, run.urls).select("path", "record")


@query(f"WITH RECURSIVE {_RECORDS} SELECT chunk, string_agg('<!-- SOURCE: ' || source || ' -->' || chr(10) || content, chr(10) || chr(10) ORDER BY source) AS body FROM records GROUP BY chunk")
def markdown_documents(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).bodies


@query(f"WITH RECURSIVE {_RECORDS}, n AS (SELECT max(chunk) AS n FROM records) SELECT chunk, printf('=== Chunk %02d of %02d ===', chunk, n) || chr(10) || chr(10) || string_agg('=== SOURCE: ' || source || ' ===' || chr(10) || content, chr(10) || chr(10) ORDER BY source) AS body FROM records, n GROUP BY chunk, n")
def text_documents(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, format="txt", with_index=True).bodies


@query(f"""WITH RECURSIVE {_RECORDS} SELECT chunk, string_agg('<!-- paperloom-context-v1' || chr(10) || '{{' || chr(10) || '  "source": ' || to_json(source)::VARCHAR || ',' || CASE WHEN url IS NULL THEN '' ELSE chr(10) || '  "url": ' || to_json(url)::VARCHAR || ',' END
    || CASE WHEN words = 0 THEN '' ELSE chr(10) || '  "word_count": ' || words || ',' END || chr(10) || '  "schema_version": "v1"' || chr(10) || '}}' || chr(10) || '-->' || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY source) AS body FROM records GROUP BY chunk""")
def header_documents(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, context_header=True).bodies


@query(f"WITH RECURSIVE {_RECORDS} SELECT id, source, words, content, url FROM records")
def pack_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Chunk bodies of JSON lines written and read as a pack."""
    folder = _folder(spark, "packs")
    writers.write_chunks(_packed(spark, d, format="jsonl").bodies, folder)
    return readers.pack_folders(spark, folder).select("id", "source", "words", "content", "url")


@query(f"WITH RECURSIVE {_RECORDS} SELECT DISTINCT printf('docs_chunk_%02d', chunk) AS chunk_id, 'txt' AS format FROM records")
def chunks_discovered(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "packs")
    writers.write_chunks(_packed(spark, d).bodies, folder)
    return artifacts.discover_chunks(spark, folder).select("chunk_id", "format")


@query(f"WITH RECURSIVE {_RECORDS} SELECT source AS path, url FROM records WHERE url IS NOT NULL")
def original_urls(spark: SparkSession, d: str) -> DataFrame:
    return artifacts.original_urls(_docs(spark, d), _urls(spark, d))


@query("SELECT printf('%s/doc_%06d.txt', source, doc_id) AS path, CASE WHEN doc_id % 5 = 0 THEN 'in place of ' || doc_id WHEN doc_id % 7 = 0 OR text IS NULL THEN '[left out: ' || printf('%s/doc_%06d.txt', source, doc_id) || ' could not be read]' ELSE text END AS text FROM documents")
def text_overrides(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    read = docs.select("path", F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"))
    return artifacts.with_overrides(read, docs.where("doc_id % 5 = 0").select("path", F.concat(F.lit("in place of "), F.col("doc_id").cast("string")).alias("text")))


@query(f"""WITH RECURSIVE {_FOLD}, c AS (SELECT chunk, count(*) AS files, sum(words) AS words FROM fold GROUP BY chunk)
SELECT sum(files)::BIGINT AS files, count(*) AS chunks, sum(words)::BIGINT AS words, min(words)::BIGINT AS least, max(words)::BIGINT AS most, round(avg(words), 6) AS average, count_if(words > {PACK_WORDS})::BIGINT AS over_words, 0::BIGINT AS excluded, count(*) > 50 AS over_chunks FROM c""")
def pack_summary(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).summary


@query(f"WITH {_ASSIGN} SELECT (SELECT count(*) FROM benchmark) AS queries, (SELECT count(*) FROM claimed) AS matched, (SELECT count(*) FROM documents) - (SELECT count(*) FROM claimed) AS unmatched")
def query_packing_summary(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = _searchable(spark, d), _questions(spark, d)
    return artifacts.query_packing_summary(asked, retrieval.assignments(docs, asked), docs)


# --- manifests and other sidecars with state between runs


@query(f"WITH {_SNAP} SELECT key, size_bytes::BIGINT AS size_bytes, mtime, content_hash FROM old")
def manifest_saved(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "state")
    artifacts.save_manifest(_snapshots(spark, d)[0], folder, "https://site.example")
    return artifacts.load_manifest(spark, folder).select("key", "size_bytes", "mtime", "content_hash")


@query(f"WITH {_SNAP} SELECT change AS what, key AS name, ''::VARCHAR AS files FROM diffs WHERE change IS NOT NULL UNION ALL SELECT 'chunk', printf('docs_chunk_%02d', key::BIGINT % 9), string_agg(key, ',' ORDER BY key) FROM new GROUP BY key::BIGINT % 9")
def delta_saved(spark: SparkSession, d: str) -> DataFrame:
    """Two runs: the first saves its manifest, the second compares with it and tells what changed and which chunks it made."""
    folder = _folder(spark, "state")
    old, new = _snapshots(spark, d)
    if artifacts.load_manifest(spark, folder) is not None:
        raise AssertionError("a first run has no manifest")
    artifacts.save_manifest(old, folder)
    diff = snapshots.manifest_diff(artifacts.load_manifest(spark, folder), new)
    members = new.select((F.col("key").cast("bigint") % 9).alias("chunk"), F.col("key").alias("path"))
    artifacts.write_delta_manifest(diff, members, folder, "2026-01-01T00:00:00Z")
    return artifacts.delta_manifest(spark, folder).select("what", "name", F.array_join(F.coalesce("files", F.array().cast("array<string>")), ",").alias("files"))


@query(f"WITH {_FACTS} SELECT printf('docs_chunk_%02d', f.doc_id) AS chunk_id, c.extracted_words::BIGINT AS word_count, printf('%.3f', noise)::DOUBLE AS noise_ratio, f.whole AS boundary_integrity, depth AS context_depth, printf('%.2f', score)::DOUBLE AS score, grade FROM final f JOIN facts c USING (doc_id)")
def readiness_saved(spark: SparkSession, d: str) -> DataFrame:
    """The scores of documents as chunks, saved as a snapshot and read again."""
    folder = _folder(spark, "state")
    artifacts.write_readiness(_scored(spark, d).withColumnRenamed("doc_id", "chunk"), folder)
    return artifacts.load_readiness(spark, folder)


@query(f"WITH RECURSIVE {_LINKED} SELECT count(*) AS links, count_if(target_chunk IS NULL)::BIGINT AS unresolved FROM edges")
def cross_ref_totals(spark: SparkSession, d: str) -> DataFrame:
    return artifacts.cross_reference_totals(_edges(spark, d)[1])


@query(f"""WITH RECURSIVE {_LINKED}, ways AS (SELECT DISTINCT source_chunk, target_chunk FROM edges WHERE target_chunk IS NOT NULL)
SELECT printf('docs_chunk_%02d', source_chunk) AS chunk_id, string_agg(printf('docs_chunk_%02d', target_chunk), ',' ORDER BY target_chunk) AS references_to FROM ways GROUP BY source_chunk""")
def cross_refs_saved(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "state")
    artifacts.write_cross_references(linkgraph.reference_sets(_edges(spark, d)[1]), folder)
    return artifacts.load_cross_references(spark, folder).where("size(references_to) > 0").select("chunk_id", F.array_join("references_to", ",").alias("references_to"))


# --- listings, downloads, discovery


@query(f"SELECT printf('%s/doc_%06d.txt', source, doc_id) AS path, {_words('text')} AS words FROM documents WHERE text IS NOT NULL")
def files_read(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as one text file for each source, read as files, and cut into documents again."""
    folder = _folder(spark, "files")
    docs = _docs(spark, d).where("text is not null").select("source", F.concat_ws("\t", "path", F.translate("text", "\n", "\x01")).alias("value"))
    docs.repartition("source").write.partitionBy("source").text(folder)
    held = readers.texts(readers.files(spark, folder, ["*.crc", "_SUCCESS"]))
    lines = held.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.select(F.split_part("line", F.lit("\t"), F.lit(1)).alias("path"), text.word_count(F.translate(F.split_part("line", F.lit("\t"), F.lit(2)), "\x01", "\n")).alias("words"))


@query("SELECT count_if(page_id % 4 = 0 OR page_id % 3 = 0)::BIGINT AS touched, count_if(page_id % 4 <> 0 AND page_id % 3 <> 0)::BIGINT AS unchanged, sum(strlen(html))::BIGINT AS bytes, false AS too_shallow FROM pages")
def download_stats(spark: SparkSession, d: str) -> DataFrame:
    p = readers.page_files(spark, d)
    now = p.select("path", "page_id", F.when(F.col("page_id") % 3 == 0, 2.0).otherwise(1.0).alias("mtime"), F.octet_length("html").cast("bigint").alias("size"))
    return artifacts.download_stats(now, artifacts.directory_snapshot(now.where("page_id % 4 <> 0").withColumn("mtime", F.lit(1.0))))


@query("SELECT page_id, true AS taken, regexp_matches(url, '^[a-z]+://[^?#]*[.]html?([?#].*)?$') AS narrow FROM pages")
def content_filters(spark: SparkSession, d: str) -> DataFrame:
    p = readers.table(spark, d, "pages")
    return p.select("page_id", artifacts.content_filter(F.col("url")).alias("taken"), artifacts.content_filter(F.col("url"), ".HTML, htm").alias("narrow"))


_SITES = f"sites AS (SELECT {_HOST} AS host, min(page_id) AS k FROM pages GROUP BY 1)"


@query(f"WITH {_SITES} SELECT 'https://' || host AS site, 'https://' || host || CASE WHEN k % 3 = 0 THEN '/llms-full.txt' ELSE '/llms.txt' END AS url FROM sites")
def llms_probe(spark: SparkSession, d: str) -> DataFrame:
    """Each host's snapshots of both files, the first of which is empty for every third."""
    sites = readers.table(spark, d, "pages").groupBy(discovery.host(F.col("url")).alias("host")).agg(F.min("page_id").alias("k"))
    at = lambda name: F.concat(F.lit("https://"), "host", F.lit("/" + name))
    both = sites.select(at("llms.txt").alias("url"), F.when(F.col("k") % 3 == 0, " \n").otherwise("- [a](https://a.example/x)").alias("body"))
    bodies = both.unionByName(sites.select(at("llms-full.txt").alias("url"), F.lit("https://a.example/full").alias("body")))
    return artifacts.first_answer(bodies, artifacts.LLMS_NAMES).select("site", "url")


@query(f"WITH {_SITES} SELECT 'https://' || host AS site, 'https://' || host || '/' || CASE k % 3 WHEN 0 THEN 'sitemap.xml' WHEN 1 THEN 'sitemap_index.xml' ELSE 'sitemap-index.xml' END AS url FROM sites")
def sitemap_candidates(spark: SparkSession, d: str) -> DataFrame:
    sites = readers.table(spark, d, "pages").groupBy(discovery.host(F.col("url")).alias("host")).agg(F.min("page_id").alias("k"))
    rows = sites.select("k", F.col("host"), F.posexplode(F.array(*map(F.lit, artifacts.SITEMAP_NAMES))).alias("nth", "name"))
    bodies = rows.select(F.concat(F.lit("https://"), "host", F.lit("/"), "name").alias("url"), F.when(F.col("nth") >= F.col("k") % 3, "<urlset/>").otherwise("").alias("body"))
    return artifacts.first_answer(bodies, artifacts.SITEMAP_NAMES).select("site", "url")


@query("SELECT url, min(CASE WHEN page_id % 2 = 0 THEN printf('f%d', page_id) END) IS NOT NULL AND min(page_id) % 2 = 0 AS cached FROM pages GROUP BY url")
def crawl_cached(spark: SparkSession, d: str) -> DataFrame:
    p = readers.table(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("k"))
    name = F.format_string("f%d", "k")
    return artifacts.crawl_cache(p, p.select("url", name.alias("key"), F.lit(None).cast("string").alias("local_path")), p.where("k % 2 = 0").select(name.alias("path"))).select("url", "cached")


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS query_id, trim(replace(text, chr(10), ' '), ' ') AS text FROM benchmark")
def query_file(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's texts written as a file of queries with comments and blank lines, and read again."""
    folder = _folder(spark, "queries")
    rows = readers.table(spark, d, "benchmark").select("item_id", F.explode(F.array(F.lit("# a comment"), F.lit(""), F.regexp_replace("text", "\n", " "))).alias("value"), F.lit(0).alias("k"))
    rows.coalesce(1).sortWithinPartitions("item_id", F.col("value").startswith("#").cast("int").desc(), "value").select("value").write.text(folder)
    return chunking.numbered(readers.query_lines(spark, folder), ["query_id"], "n").select((F.col("n") - 1).alias("query_id"), "text")


# --- serving and streaming


_ASKED_TEXT = "the stone and the water"


@query(f"""WITH RECURSIVE {_RECORDS}, tok AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9]+') AS t FROM records), stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
posted AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
asked AS (SELECT term, count(*) AS times FROM (SELECT unnest(regexp_extract_all('{_ASKED_TEXT}', '[a-z0-9]+')) AS term) GROUP BY term),
scored AS (SELECT id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))), 6) AS score FROM asked JOIN posted USING (term) JOIN dfs USING (term), stats GROUP BY id)
SELECT id, 'docs_chunk_' || string_split(id, '_')[1] AS chunk_id, source, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, id)::BIGINT AS rank FROM scored JOIN records USING (id) WHERE score > 0 ORDER BY scored.score DESC, id LIMIT 7""")
def serve_search(spark: SparkSession, d: str) -> DataFrame:
    """What the search tool answers over the pack of the documents."""
    run = _packed(spark, d, format="jsonl")
    pack = run.pieces.select(F.format_string("%02d_%s", "chunk", "path").alias("id"), F.col("path").alias("source"), F.col("text").alias("content"), "breadcrumb", F.lit("").alias("readiness_grade"))
    tool = {t.name: t for t in serving.pack_tools(pack)}["search_chunks"]
    rows = tool.run({"query": _ASKED_TEXT, "k": 7})["results"]
    return spark.createDataFrame([(r["id"], r["chunk_id"], r["source"], r["score"], r["rank"]) for r in rows], "id string, chunk_id string, source string, score double, rank bigint")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.change_windows(readers.table(spark, d, "events")).select("start", "event_type", "events")


@query(f"WITH {_SNAP} SELECT count(*) AS changes, count_if(change = 'added')::BIGINT AS added FROM diffs WHERE change IS NOT NULL")
def first_and_second_run(spark: SparkSession, d: str) -> DataFrame:
    """The gate over a manifest that an earlier run saved."""
    folder = _folder(spark, "state")
    old, new = _snapshots(spark, d)
    artifacts.save_manifest(old, folder)
    return snapshots.manifest_diff(artifacts.load_manifest(spark, folder), new).agg(F.count("*").alias("changes"), F.count_if(F.col("change") == "added").alias("added"))


@query(f"WITH RECURSIVE {_NEXT_FIT} SELECT chunk, count(*) AS files FROM fold GROUP BY chunk")
def dry_run_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a dry run, whose scores count no broken boundary."""
    run = pipeline.pack(_text_pages(spark, d), pipeline.PackConfig(max_words=MAX_WORDS, dry_run=True, score=True))
    bad = run.scores.where("not whole")
    return chunking.chunk_totals(run.members).join(bad, "chunk", "left_anti").select("chunk", "files")


