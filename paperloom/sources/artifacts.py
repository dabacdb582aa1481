"""Files beside a pack: manifests, delta manifests, readiness snapshots, cross references; listings and summaries."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.chunking import chunk_id
from paperloom.operators.readiness import artifact_columns, dominant_penalty, penalties
from paperloom.operators.snapshots import ENTRY

MANIFEST, DELTA, READINESS, REFERENCES = "manifest", "delta-manifest", "readiness", "cross-references"
TEXT_EXTENSIONS = ("html", "md", "txt")
#: What a crawl for text leaves out; addresses without an extension pass.
ASSETS = tuple("7z avi bin bmp bz2 css dmg eot exe gif gz ico jpeg jpg js map mjs mov mp3 mp4 ogg otf pdf png rar svg tar tiff ttf wasm wav webm webp woff woff2 zip".split())
SITEMAP_NAMES = ("sitemap.xml", "sitemap_index.xml", "sitemap-index.xml")
LLMS_NAMES = ("llms.txt", "llms-full.txt")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def sidecar(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame | None:
    """The rows of a sidecar, a folder of JSON lines or one JSON file; None where it is missing or nothing of it can be read."""
    path = f"{folder.rstrip('/')}/{name}"
    if not _exists(spark, path):
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.option("mode", "DROPMALFORMED").option("multiLine", str(name.endswith(".json")).lower()).json(path)
    return None if not rows.columns or rows.isEmpty() else rows


def save_manifest(manifest: DataFrame, folder: str, base_url: str = "", last_run: str = "") -> None:
    """Manifest entries (key and fields), one JSON object a line, written by the executors."""
    have = [c for c in ENTRY if c in manifest.columns]
    rows = manifest.select("key", *have, F.lit(base_url).alias("base_url"), F.lit(last_run).alias("last_run"))
    rows.write.mode("overwrite").json(f"{folder.rstrip('/')}/{MANIFEST}")


def load_manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The entries of :func:`save_manifest`; None on a first run."""
    from paperloom.sources.readers import MANIFEST_ENTRY

    return sidecar(spark, folder, MANIFEST, f"key string, {MANIFEST_ENTRY}")


def write_delta_manifest(diff: DataFrame, members: DataFrame, folder: str, timestamp: str, prefix: str = "docs_chunk_") -> None:
    """(what, name, files, timestamp): one JSON line for each changed key and each chunk made, with its files in order."""
    changed = diff.select(F.col("change").alias("what"), F.col("key").alias("name"), F.lit(None).cast("array<string>").alias("files"))
    made = members.groupBy("chunk").agg(F.sort_array(F.collect_list("path")).alias("files")).select(F.lit("chunk").alias("what"), chunk_id(F.col("chunk"), prefix).alias("name"), "files")
    changed.unionByName(made).withColumn("timestamp", F.lit(timestamp)).write.mode("overwrite").json(f"{folder.rstrip('/')}/{DELTA}")


def delta_manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """What :func:`write_delta_manifest` wrote, or None."""
    return sidecar(spark, folder, DELTA, "what string, name string, files array<string>, timestamp string")


def readiness_snapshot(scores: DataFrame, prefix: str = "docs_chunk_") -> DataFrame:
    """Scores of chunks as a snapshot shows them: (chunk_id, word_count, noise_ratio, boundary_integrity, context_depth, score, grade)."""
    rows = artifact_columns(scores)
    return rows.select(chunk_id(F.col("chunk"), prefix).alias("chunk_id"), F.col("extracted_words").alias("word_count"), "noise_ratio", F.col("whole").alias("boundary_integrity"), "context_depth", "score", "grade")


def write_readiness(scores: DataFrame, folder: str, prefix: str = "docs_chunk_") -> None:
    readiness_snapshot(scores, prefix).write.mode("overwrite").json(f"{folder.rstrip('/')}/{READINESS}")


def load_readiness(spark: SparkSession, folder: str) -> DataFrame | None:
    """The snapshot of an earlier run, or None on the first."""
    return sidecar(spark, folder, READINESS, "chunk_id string, word_count bigint, noise_ratio double, boundary_integrity boolean, context_depth int, score double, grade string")


def write_cross_references(sets: DataFrame, folder: str, prefix: str = "docs_chunk_") -> None:
    """Reference sets by chunk id, one JSON line each."""
    name = lambda c: F.transform(c, lambda x: chunk_id(x, prefix))
    rows = sets.select(chunk_id(F.col("chunk"), prefix).alias("chunk_id"), name("references_to").alias("references_to"), name("referenced_by").alias("referenced_by"))
    rows.write.mode("overwrite").json(f"{folder.rstrip('/')}/{REFERENCES}")


def load_cross_references(spark: SparkSession, folder: str) -> DataFrame | None:
    return sidecar(spark, folder, REFERENCES, "chunk_id string, references_to array<string>, referenced_by array<string>")


def discover_chunks(spark: SparkSession, folder: str, prefix: str = "docs_chunk_") -> DataFrame:
    """(chunk_id, format, path) of the chunk files of a folder, single files or the folders of ``write_chunks``, by id and format."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    own = F.regexp_extract("path", rf"/chunk=({prefix}[^/]*)/part-[^/]*$", 1)
    single = rf"/({prefix}[^/]*)\.(md|txt|jsonl)$"
    rows = listed.select(F.when(own != "", own).otherwise(F.regexp_extract("path", single, 1)).alias("chunk_id"), F.when(own != "", "txt").otherwise(F.regexp_extract("path", single, 2)).alias("format"), "path")
    return rows.where("chunk_id <> ''").groupBy("chunk_id", "format").agg(F.min("path").alias("path")).orderBy("chunk_id", "format")


def list_chunks(chunks: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """(chunk_id, format, grade, score): the list mode of explain; grades where the snapshot has them."""
    if snapshot is None:
        return chunks.select("chunk_id", "format", F.lit(None).cast("string").alias("grade"), F.lit(None).cast("double").alias("score"))
    return chunks.select("chunk_id", "format").join(snapshot.select("chunk_id", "grade", "score"), "chunk_id", "left")


def pick_chunk(chunks: DataFrame, wanted: str, prefix: str = "docs_chunk_") -> DataFrame:
    """The files of one chunk, named by its id or by its bare number; markdown before text before JSON lines."""
    name = wanted if wanted.startswith(prefix) else prefix + wanted
    rank = F.array_position(F.array(F.lit("md"), F.lit("txt"), F.lit("jsonl")), F.col("format"))
    found = chunks.where(F.col("chunk_id") == name)
    if found.isEmpty():
        raise ValueError(f"there is no chunk {name!r}")
    return found.orderBy(rank)


def directory_snapshot(files: DataFrame) -> DataFrame:
    """(path, mtime) of listed files; the contents aren't read."""
    return files.select("path", "mtime")


def download_stats(files: DataFrame, before: DataFrame | None) -> DataFrame:
    """One row: touched and unchanged files (path, mtime) against an earlier snapshot, of which none means a full run; bytes and whether the mirror is too shallow.

    A file is touched if it is new or later than before. With at most one HTML file a mirror is too shallow.
    """
    rows = files.withColumn("_before", F.lit(None).cast("double")) if before is None else files.join(before.select("path", F.col("mtime").alias("_before")), "path", "left")
    touched = F.col("_before").isNull() | (F.col("mtime") > F.col("_before"))
    return rows.agg(F.count_if(touched).alias("touched"), F.count_if(~touched).alias("unchanged"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"), (F.count_if(F.col("path").rlike(r"(?i)\.html?$")) <= 1).alias("too_shallow"))


def content_filter(url: Column, extensions: str = ",".join(TEXT_EXTENSIONS)) -> Column:
    """Whether a crawl takes an address by its extension: with the default set all but assets, with another only that, with none all."""
    wanted = sorted({e.strip().lstrip(".").lower() for e in extensions.split(",") if e.strip()})
    ext = F.lower(F.regexp_extract(F.regexp_extract(url, r"^(?:[a-z]+://[^/?#]*)?([^?#]*)", 1), r"\.([^./]*)$", 1))
    if not wanted:
        return F.lit(True)
    return ~ext.isin(*ASSETS) if wanted == sorted(TEXT_EXTENSIONS) else ext.isin(*wanted)


def first_answer(bodies: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(site, url, body): of snapshots (url, body) at a site's root under the names, the first in their order that isn't empty."""
    root = F.regexp_extract("url", r"^([a-z]+://[^/]+)/[^/]+$", 1)
    rank = F.array_position(F.array(*map(F.lit, names)), F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/]+)$", 1))
    held = bodies.where(F.col("body").rlike(r"\S")).select(root.alias("site"), "url", "body", rank.alias("rank")).where("rank > 0")
    return held.groupBy("site").agg(F.min_by(F.struct("url", "body"), "rank").alias("b")).select("site", "b.*")


def with_overrides(texts: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(path, text): a text override of the path wins; a source that couldn't be read gets a line that says so."""
    lost = F.concat(F.lit("[left out: "), "path", F.lit(" could not be read]"))
    if overrides is None:
        return texts.select("path", F.coalesce("text", lost).alias("text"))
    other = overrides.select("path", F.col("text").alias("_other"))
    return texts.join(other, "path", "left").select("path", F.coalesce("_other", "text", lost).alias("text"))


def original_urls(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, url) of files (path): the URL of the entry whose local path, or without one whose key, is the file; the least key counts.

    One equi-join on whichever of the two an entry has, so there is no join with an OR.
    """
    known = manifest.where("url is not null").select(F.coalesce("local_path", "key").alias("path"), "key", "url")
    first = known.groupBy("path").agg(F.min_by("url", "key").alias("url"))
    return files.select("path").join(first, "path")


def crawl_cache(urls: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(url, path, cached): whether the manifest's entry of a URL still has its file; the least key counts."""
    known = manifest.groupBy("url").agg(F.min_by(F.coalesce("local_path", "key"), "key").alias("path"))
    there = files.select("path", F.lit(True).alias("there"))
    return urls.select("url").join(known, "url", "left").join(there, "path", "left").select("url", "path", F.coalesce("there", F.lit(False)).alias("cached"))


def pack_summary(members: DataFrame, all_files: int | None = None, max_chunks: int | None = None, max_words: int | None = None) -> DataFrame:
    """One row: files, excluded, chunks, words and their average, least and most by chunk, and what a run only warns of.

    ``over_words`` counts chunks over the limit; ``over_chunks`` says that there are more than allowed. Nothing is dropped.
    """
    by = members.groupBy("chunk").agg(F.count("*").alias("files"), F.sum("words").alias("words"))
    out = by.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.count("*").alias("chunks"), *(F.coalesce(f("words"), F.lit(0)).alias(n) for f, n in ((F.sum, "words"), (F.min, "least"), (F.max, "most"))), F.round(F.coalesce(F.avg("words"), F.lit(0.0)), 6).alias("average"), F.count_if(F.col("words") > (max_words if max_words is not None else 2**62)).alias("over_words"))
    excluded = F.lit(all_files) - F.col("files") if all_files is not None else F.lit(0)
    return out.withColumn("excluded", excluded.cast("bigint")).withColumn("over_chunks", F.col("chunks") > (max_chunks if max_chunks is not None else 2**62))


def query_packing_summary(queries: DataFrame, assigned: DataFrame, files: DataFrame) -> DataFrame:
    """One row: queries, files matched and files that no query claims."""
    out = files.agg(F.count("*").alias("n")).crossJoin(assigned.agg(F.count("*").alias("matched"))).crossJoin(queries.agg(F.count("*").alias("queries")))  # rows of one
    return out.select("queries", "matched", (F.col("n") - F.col("matched")).alias("unmatched"))


def cross_reference_totals(edges: DataFrame) -> DataFrame:
    """One row: links and those without a target."""
    return edges.agg(F.count("*").alias("links"), F.count_if(F.col("target_chunk").isNull()).alias("unresolved"))


def evaluation_payload(overall: DataFrame, by_grade: DataFrame, k: int) -> dict[str, Any]:
    """The report of an evaluation; a row overall and one for each grade reach the driver."""
    one = overall.first()
    return {"k": k, "total_questions": one["questions"], "hits": one["hits"], "hit_rate": one["hit_rate"], "mrr": one["mrr"], "per_grade": {r["grade"]: {c: r[c] for c in ("questions", "hits", "hit_rate")} for r in by_grade.orderBy("grade").collect()}}


def evaluation_text(payload: dict[str, Any]) -> str:
    lines = [f"questions {payload['total_questions']}, found among {payload['k']}: {payload['hits']} ({payload['hit_rate']:.1%}), mean reciprocal rank {payload['mrr']:.3f}"]
    return "\n".join(lines + [f"  grade {g}: {v['hits']} of {v['questions']} ({v['hit_rate']:.1%})" for g, v in payload["per_grade"].items()])


def ranked_by_need(scores: DataFrame) -> DataFrame:
    """(chunk, grade, score, penalty, kind) of scored chunks, worst first."""
    of = penalties(F.col("noise_ratio"), F.col("whole"), F.col("context_depth"))
    return scores.select("chunk", "grade", "score", dominant_penalty(of).alias("kind")).orderBy("score", "chunk")


def terminal_report(scores: DataFrame, path: str, prefix: str = "docs_chunk_") -> list[tuple[str | None, str]]:
    """(grade, line) pairs, worst first, with lines of no grade around them; one row a chunk reaches the driver."""
    rows = ranked_by_need(scores).collect()
    body = [(r["grade"], f"{prefix}{r['chunk']:02d}: {r['score']:.2f}, loses most by {r['kind']}") for r in rows]
    return [(None, "Readiness, worst first"), *body, (None, f"Written to {path}")]
