"""Corpora, packs, manifests, queries and sidecars as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.markup import parse_page
from paperloom.functions.text import is_html
from paperloom.operators.discovery import filter_files
from paperloom.session import spread

PACK = (
    "id string, source string, words bigint, content string, schema_version string, breadcrumb array<string>,"
    " chunk_index bigint, total_chunks bigint, url string, readiness_grade string"
)
MANIFEST_ENTRY = "url string, size_bytes bigint, etag string, last_modified string, local_path string, mtime double, content_hash string"
READINESS = "chunk_id string, score double, grade string, noise_ratio double, boundary_integrity boolean, context_depth int, word_count bigint"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder, on all cores."""
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, source, doc_id): the documents table as text files, a directory for each source."""
    d = table(spark, folder, "documents")
    return d.select(F.format_string("%s/doc_%06d.txt", "source", "doc_id").alias("path"), "text", "source", "doc_id")


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, html, url, page_id): pages under their URL's path, ``index.html`` added."""
    p = table(spark, folder, "pages")
    step = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "/+$", "")
    return p.select(F.concat(step, F.format_string("/p%06d.html", "page_id")).alias("path"), "html", "url", "page_id")


def files(spark: SparkSession, folder: str, patterns: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """(path, content, mtime, size) below a folder: no binaries, nothing ignored, nothing under ``skip``.

    Predicates use the path alone, so contents of files that go are never read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = "^(?:[a-z0-9]+:)?/*" + folder.split(":", 1)[-1].strip("/").replace(".", "\\.") + "/"
    rows = raw.select(F.regexp_replace("path", root, "").alias("path"), "content", F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"))
    for prefix in skip or []:
        rows = rows.where(~F.col("path").startswith(prefix))
    return filter_files(rows, patterns or [])


def texts(rows: DataFrame, extract: bool = True) -> DataFrame:
    """(path, text, headings) of files (path, content): UTF-8 with replacement; HTML becomes text."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    parsed = rows.select("path", text.alias("body"), is_html(F.col("path")).alias("markup"))
    parsed = parsed.withColumn("page", F.when(F.col("markup"), parse_page(F.when(F.col("markup"), F.col("body")))))
    view = F.col("page.main_text") if extract else F.col("page.raw_text")
    return parsed.select("path", F.when(F.col("markup"), view).otherwise(F.col("body")).alias("text"), F.col("page.headings").alias("headings"))


def _records(raw: DataFrame) -> DataFrame:
    """Records of (file, line, row); lines that are no objects are skipped, members that are missing are empty."""
    row = F.from_json("row", PACK, {"mode": "PERMISSIVE"})
    held = raw.where(F.trim("row").startswith("{")).select("file", "line", row.alias("r")).where("r is not null and not (r.id is null and r.content is null)")
    r = held.select("file", "line", "r.*")
    return r.fillna({"id": "", "source": "", "content": "", "words": 0, "readiness_grade": ""}).withColumn("breadcrumb", F.coalesce("breadcrumb", F.array().cast("array<string>")))


def pack(spark: SparkSession, folder: str, prefix: str = "docs_chunk_") -> DataFrame:
    """Records of ``prefix*.jsonl`` with (file, line); lines that are no objects are skipped."""
    raw = spark.read.option("pathGlobFilter", f"{prefix}*.jsonl").text(folder, wholetext=True)
    return _records(raw.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "row")))


def pack_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a pack of JSON lines as ``write_chunks`` leaves it: ``file`` is the chunk, ``line`` is null."""
    return _records(spark.read.text(folder).select(F.col("chunk").alias("file"), F.lit(None).cast("int").alias("line"), F.col("value").alias("row")))


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(key, entry fields); None where the file is missing or no manifest. Unknown fields are dropped."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    schema = f"base_url string, last_run string, files map<string, struct<{MANIFEST_ENTRY.replace(' ', ':').replace(',:', ', ')}>>"
    whole = spark.read.schema(schema).json(path, multiLine=True).where("files is not null")
    return None if whole.isEmpty() else whole.select(F.explode("files").alias("key", "e")).select("key", "e.*")


def readiness(spark: SparkSession, path: str) -> DataFrame:
    """Chunk scores of a snapshot; a malformed one is an error. Of repeated ids the last counts."""
    schema = f"chunks array<struct<{READINESS.replace(' ', ':').replace(',:', ', ')}>>"
    rows = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST").select(F.posexplode("chunks").alias("pos", "c"))
    checked = rows.select("pos", "c.*").where(F.expr("assert_true(chunk_id is not null and score is not null and grade is not null) is null"))
    last = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("pos")))
    return checked.withColumn("n", last).where("n = 1").drop("n", "pos")


def query_lines(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text): lines of a file but blank ones and comments, in order."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("query_id", "text"))
    return rows.select("query_id", F.trim("text").alias("text")).where("text <> '' and not text like '#%'")
