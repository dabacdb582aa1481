"""Chunks as Markdown, text and JSON lines; context headers, guides and sidecars."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.structure import subchunks
from paperloom.functions.text import word_count
from paperloom.operators.chunking import chunk_id
from paperloom.operators.linkgraph import active_headings
from paperloom.operators.readiness import artifact_columns, dominant_penalty, penalties
from paperloom.session import shuffled

FORMATS = ("md", "txt", "jsonl")
MARKS = {"md": ("<!-- SOURCE: ", " -->\n"), "txt": ("=== SOURCE: ", " ===\n")}
HEADER = "paperloom-context-v1"


def context_header(payload: Column) -> Column:
    """An HTML comment around indented JSON; members that are null, empty or 0 are left out, and nothing at all gives an empty text.

    ``payload`` is a struct (source, url, chunk_index, total_chunks, word_count, breadcrumb, score, grade, noise_ratio).
    """

    def run(column: pa.Array) -> pa.Array:
        out = []
        for p in column.to_pylist():
            body = {"source": p["source"], "url": p["url"]}
            if (p["total_chunks"] or 0) > 1:
                body |= {"chunk_index": p["chunk_index"], "total_chunks": p["total_chunks"]}
            body |= {"word_count": p["word_count"], "context_breadcrumb": p["breadcrumb"]}
            if p["grade"]:
                body["llm_readiness"] = {"score": round(p["score"], 2), "grade": p["grade"], "noise_ratio": round(p["noise_ratio"], 3)}
            body = {k: v for k, v in body.items() if v}
            text = json.dumps({**body, "schema_version": "v1"}, indent=2, ensure_ascii=False)
            out.append(f"<!-- {HEADER}\n{text}\n-->\n\n" if body else "")
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(payload)


def pieces(files: DataFrame, max_words: int) -> DataFrame:
    """Sub-chunks (path, chunk, piece, pieces, text, words, breadcrumb) of files (path, chunk, text, headings).

    A file without headings stays whole. If no heading holds at the start of the first piece, those at
    the first heading do.
    """
    cut = F.when((F.size(F.coalesce("headings", F.array().cast("array<struct<level:int,text:string,char_offset:bigint>>"))) > 0) & F.lit(max_words > 0), subchunks(F.col("text"), max_words))
    whole = F.array(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.lit(0).cast("bigint").alias("char_offset")))
    rows = files.select("path", "chunk", "headings", F.coalesce(cut, whole).alias("cut"))
    rows = rows.select("path", "chunk", "headings", F.size("cut").alias("pieces"), F.posexplode("cut").alias("piece", "p"))
    held = active_headings(F.col("headings"), F.col("p.char_offset"))
    first = active_headings(F.col("headings"), F.get("headings", F.lit(0))["char_offset"])
    shown = F.when((F.col("piece") == 0) & (F.size(held) == 0), first).otherwise(held)
    names = F.transform(F.coalesce(shown, F.array().cast("array<struct<level:int,text:string,char_offset:bigint>>")), lambda h: h["text"])
    return rows.select("path", "chunk", (F.col("piece") + 1).alias("piece"), "pieces", F.col("p.text").alias("text"), word_count(F.col("p.text")).alias("words"), names.alias("breadcrumb"))


def jsonl_records(cut: DataFrame, urls: DataFrame | None = None, grades: DataFrame | None = None) -> DataFrame:
    """(chunk, path, piece, record): one JSON object a piece; absent members are left out, never null."""
    rows = cut.join(shuffled(urls.select("path", "url")), "path", "left") if urls is not None else cut.withColumn("url", F.lit(None).cast("string"))
    rows = rows.join(grades.select("chunk", "grade"), "chunk", "left") if grades is not None else rows.withColumn("grade", F.lit(None).cast("string"))
    many = F.col("pieces") > 1
    name = F.when(many, F.format_string("%02d_%d_%s", "chunk", "piece", "path")).otherwise(F.format_string("%02d_%s", "chunk", "path"))
    body = F.struct(
        name.alias("id"), F.col("path").alias("source"), "words", F.col("text").alias("content"), F.lit("v1").alias("schema_version"),
        F.when(F.size("breadcrumb") > 0, F.col("breadcrumb")).alias("breadcrumb"), F.when(many, F.col("piece")).alias("chunk_index"),
        F.when(many, F.col("pieces")).alias("total_chunks"), "url", F.col("grade").alias("readiness_grade"),
    )
    return rows.select("chunk", "path", "piece", F.to_json(body).alias("record"))


def header_scores(scores: DataFrame) -> DataFrame:
    """(chunk, score, grade, noise_ratio): what context headers show of a chunk's readiness."""
    return artifact_columns(scores).select("chunk", "score", "grade", "noise_ratio")


def chunk_bodies(cut: DataFrame, fmt: str = "md", headers: bool = False, index: bool = False, urls: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """(chunk, body): the text of each chunk file, its pieces in order of path and piece.

    Headers and records name the page's URL from ``urls`` (path, url) and the chunk's grade from ``scores``.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; use one of {', '.join(FORMATS)}")
    if fmt == "jsonl":
        rows = jsonl_records(cut, urls, scores).select("chunk", F.struct("path", "piece", F.col("record").alias("t")).alias("p"))
        return rows.groupBy("chunk").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"]), "\n"), F.lit("\n")).alias("body"))
    before, behind = MARKS[fmt]
    mark = F.when(F.col("piece") == 1, F.concat(F.lit(before), "path", F.lit(behind))).otherwise("")
    head = F.lit("")
    if headers:
        none = lambda kind: F.lit(None).cast(kind)
        cut = cut.join(shuffled(urls.select("path", "url")), "path", "left") if urls is not None else cut.withColumn("url", none("string"))
        if scores is not None:
            cut = cut.join(header_scores(scores), "chunk", "left")
        else:
            cut = cut.withColumns({"score": none("double"), "grade": none("string"), "noise_ratio": none("double")})
        payload = F.struct(F.col("path").alias("source"), "url", F.col("piece").alias("chunk_index"), F.col("pieces").alias("total_chunks"), F.col("words").alias("word_count"), "breadcrumb", "score", "grade", "noise_ratio")
        mark, head = F.lit(""), context_header(payload)
    rows = cut.select("chunk", F.struct("path", "piece", F.concat(mark, head, "text").alias("t")).alias("p"))
    out = rows.groupBy("chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"]), "\n\n").alias("body"))
    if index:
        out = out.crossJoin(F.broadcast(out.agg(F.count("*").alias("n"))))  # one row
        title = "# Chunk %02d of %02d\n\n%s" if fmt == "md" else "=== Chunk %02d of %02d ===\n\n%s"
        out = out.select("chunk", F.format_string(title, "chunk", "n", "body").alias("body"))
    return out


def write_chunks(bodies: DataFrame, folder: str, prefix: str = "docs_chunk_") -> None:
    """One folder ``chunk=<id>`` for each chunk with its text, written by the executors."""
    bodies.select(chunk_id(F.col("chunk"), prefix).alias("chunk"), F.col("body").alias("value")).repartition("chunk").write.partitionBy("chunk").mode("overwrite").option("lineSep", "\n").text(folder)


def import_guide(members: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """(chunk, file, words, section): section is the first heading of the first file, else its folder, else its name."""
    first = members.groupBy("chunk").agg(F.sum("words").alias("words"), F.min("path").alias("path"))
    first = first.join(headings.select("path", F.get("headings", F.lit(0))["text"].alias("title")), "path", "left") if headings is not None else first.withColumn("title", F.lit(None).cast("string"))
    folder = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    section = F.coalesce("title", F.when(folder != "", folder), stem)
    return first.select("chunk", F.concat(chunk_id(F.col("chunk")), F.lit(".md")).alias("file"), "words", section.alias("section"))


def sections(text: Column) -> Column:
    """Array of (content, source, breadcrumb): a chunk file cut at context headers, else at source marks, else whole."""
    import re

    head = re.compile(rf"<!-- {HEADER}\n(.*?)\n-->\n?", re.S)
    marks = [re.compile(re.escape(a) + "(.*?)" + re.escape(b.rstrip("\n")) + "\n?") for a, b in MARKS.values()]
    kind = pa.list_(pa.struct([("content", pa.string()), ("source", pa.string()), ("breadcrumb", pa.list_(pa.string()))]))

    def meta(found: re.Match, is_head: bool) -> tuple[str, list[str]]:
        if not is_head:
            return found.group(1), []
        try:
            body = json.loads(found.group(1))
        except json.JSONDecodeError:
            return "", []
        return body.get("source", ""), list(body.get("context_breadcrumb") or [])

    def cut(t: str) -> list[dict]:
        for pattern in (head, *marks):
            hits = list(pattern.finditer(t))
            if not hits:
                continue
            ends = [m.start() for m in hits[1:]] + [len(t)]
            out = [{"content": t[m.end() : e].strip("\n"), **dict(zip(("source", "breadcrumb"), meta(m, pattern is head), strict=True))} for m, e in zip(hits, ends, strict=True)]
            lead = t[: hits[0].start()].strip("\n")
            return ([{"content": lead, "source": "", "breadcrumb": []}] if lead.strip() else []) + out
        return [{"content": t, "source": "", "breadcrumb": []}]

    def run(column: pa.Array) -> pa.Array:
        return pa.array([cut(t or "") for t in column.to_pylist()], kind)

    return F.arrow_udf(run, "array<struct<content:string,source:string,breadcrumb:array<string>>>")(text)


def readiness_html(scores: DataFrame, pages: DataFrame | None = None) -> str:
    """The report of all chunks, worst first, with their penalties, and of pages, every text escaped.

    ``scores`` is what ``score_chunks`` gives; ``pages`` has (path, raw_words, extracted_words, headings, removed,
    issues), the last two as arrays of texts. One row a chunk and one a page reach the driver.
    """
    from html import escape

    of = penalties(F.col("noise_ratio"), F.col("whole"), F.col("context_depth"))
    rows = scores.select("chunk", "grade", "score", "noise_ratio", "whole", "context_depth", of.alias("lost"), dominant_penalty(of).alias("kind")).orderBy("score", "chunk").collect()
    cell = lambda *values: "<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in values) + "</tr>"
    names = ("chunk", "grade", "score", "noise", "whole", "depth", "lost by noise", "lost by boundary", "lost by context", "most by")
    body = "".join(cell(f"{r['chunk']:02d}", r["grade"], f"{r['score']:.2f}", f"{r['noise_ratio']:.3f}", r["whole"], r["context_depth"], *(f"{p['penalty']:.2f}" for p in r["lost"]), r["kind"]) for r in rows)
    out = f"<!doctype html><meta charset='utf-8'><title>Readiness</title><table><tr>{''.join(f'<th>{n}</th>' for n in names)}</tr>{body}</table>"
    items = lambda title, texts: f"<p>{title}</p><ul>{''.join(f'<li><pre>{escape(t)}</pre></li>' for t in texts)}</ul>" if texts else ""
    for r in pages.orderBy("path").collect() if pages is not None else []:
        out += f"<h2>{escape(r['path'])}</h2><p>{r['extracted_words']} of {r['raw_words']} words kept, {r['headings']} headings</p>" + items("Removed", r["removed"]) + items("Broken boundaries", r["issues"])
    return out
