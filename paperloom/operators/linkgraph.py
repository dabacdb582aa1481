"""Links between files: path resolution, cross-reference edges, unresolved targets, annotation; active headings."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import shuffled

_OUTSIDE = ("http://", "https://", "mailto:", "javascript:")


def resolve(source: Column, href: Column) -> Column:
    """The normalised path that ``href`` names from the file ``source``; null for external, empty and root links.

    Targets with a leading slash stay absolute. A trailing ``index.html`` step goes.
    """
    bare = F.regexp_extract(href, "(?s)^([^#]*)", 1)
    folder = F.regexp_extract(source, r"(?s)^(.*)/[^/]*$", 1)
    whole = F.when(bare.startswith("/") | (folder == ""), bare).otherwise(F.concat(folder, F.lit("/"), bare))
    steps = F.filter(F.split(whole, "/"), lambda s: (s != "") & (s != "."))
    root = F.when(whole.rlike("^//[^/]|^//$"), "//").when(whole.startswith("/"), "/").otherwise("")

    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        back = (s == "..") & (F.size(done) > 0) & (last != "..")
        stuck = (s == "..") & (F.size(done) == 0) & (root != "")
        return F.when(back, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(stuck, done).otherwise(F.concat(done, F.array(s)))

    flat = F.when(F.array_contains(steps, ".."), F.aggregate(steps, F.array().cast("array<string>"), step)).otherwise(steps)
    path = F.concat(root, F.array_join(flat, "/"))
    path = F.when(path == "", ".").otherwise(path)
    path = F.when(path == "index.html", "").otherwise(F.regexp_replace(path, "/index\\.html$", ""))
    outside = (bare == "") | F.array_contains(F.transform(F.array(*map(F.lit, _OUTSIDE)), lambda p: href.startswith(p.substr(F.lit(1), F.length(p)))), True)
    return F.when(~outside & (path != ""), path)


def anchor(href: Column) -> Column:
    """The fragment with its sign, or an empty string."""
    return F.regexp_extract(href, "(?s)(#.*)$", 1)


def link_table(pages: DataFrame) -> DataFrame:
    """(source_path, pos, target_path, anchor, link_text) of pages (path, links)."""
    rows = pages.select(F.col("path").alias("source_path"), F.posexplode("links").alias("pos", "l"))
    rows = rows.select("source_path", "pos", resolve(F.col("source_path"), F.col("l.href")).alias("target_path"), anchor(F.col("l.href")).alias("anchor"), F.trim("l.text").alias("link_text"))
    return rows.where("target_path is not null")


def edges(links: DataFrame, members: DataFrame) -> DataFrame:
    """Links with (source_chunk, target_chunk); the latter is null if the target is in no chunk.

    A file ``dir/index.html`` is also known as ``dir``; links of files outside all chunks are left out.
    """
    known = members.select("path", "chunk")
    alias = known.where(F.col("path").endswith("/index.html")).select(F.regexp_replace("path", "/index\\.html$", "").alias("path"), "chunk")
    alias = alias.join(shuffled(known), "path", "left_anti")
    target = known.union(alias).groupBy("path").agg(F.min("chunk").alias("target_chunk")).withColumnRenamed("path", "target_path")
    source = known.select(F.col("path").alias("source_path"), F.col("chunk").alias("source_chunk"))
    return links.join(shuffled(source), "source_path").join(shuffled(target), "target_path", "left")


def reference_sets(edge_table: DataFrame) -> DataFrame:
    """(chunk, references_to, referenced_by): sorted distinct chunks; a chunk may name itself."""
    pairs = edge_table.where("target_chunk is not null").select("source_chunk", "target_chunk").distinct()
    ways = F.explode(F.array(F.struct(F.col("source_chunk").alias("chunk"), F.col("target_chunk").alias("to"), F.lit(None).cast("bigint").alias("by")), F.struct(F.col("target_chunk").alias("chunk"), F.lit(None).cast("bigint").alias("to"), F.col("source_chunk").alias("by"))))
    return pairs.select(ways.alias("w")).select("w.*").groupBy("chunk").agg(F.sort_array(F.collect_set("to")).alias("references_to"), F.sort_array(F.collect_set("by")).alias("referenced_by"))


def unresolved(edge_table: DataFrame) -> DataFrame:
    """(source_path, target_path, links) of targets in no chunk."""
    return edge_table.where("target_chunk is null").groupBy("source_path", "target_path").agg(F.count("*").alias("links"))


def _annotated(text: str, links: list[dict]) -> str:
    done = set()
    for link in links:
        name = (link["text"] or "").strip()
        if not name or name in done or link["chunk"] is None:
            continue
        after, n = re.subn(rf"(?<!\w){re.escape(name)}(?!\w)", lambda m: f"{m.group()} [-> {link['chunk']}]", text, count=1)  # noqa: B023
        if n:
            done.add(name)
            text = after
    return text


def annotate(text: Column, links: Column) -> Column:
    """The text with ``[-> chunk]`` after the first free-standing place of each link's text; links (text, chunk) in order."""

    def run(texts: pa.Array, of: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _annotated(t, own or []) for t, own in zip(texts.to_pylist(), of.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(run, "string")(text, links)


def annotated_pages(pages: DataFrame, edge_table: DataFrame, prefix: str = "docs_chunk_") -> DataFrame:
    """(path, text): pages (path, text) annotated by their own links."""
    named = edge_table.where("target_chunk is not null").select("source_path", "pos", F.struct("pos", F.col("link_text").alias("text"), F.format_string(f"{prefix}%02d", "target_chunk").alias("chunk")).alias("l"))
    own = named.groupBy(F.col("source_path").alias("path")).agg(F.sort_array(F.collect_list("l")).alias("links"))
    joined = pages.select("path", "text").join(shuffled(own), "path", "left")
    return joined.select("path", annotate(F.col("text"), F.transform("links", lambda l: F.struct(l["text"].alias("text"), l["chunk"].alias("chunk")))).alias("text"))


def active_headings(headings: Column, offset: Column) -> Column:
    """Of headings (level, text, char_offset) in order those that hold at the offset: none of the same or a lower level follows up to there."""
    seen = F.filter(headings, lambda h: h["char_offset"] <= offset)
    return F.filter(seen, lambda h, i: ~F.exists(F.slice(seen, i + 2, F.greatest(F.size(seen) - i - 1, F.lit(0))), lambda g: g["level"] <= h["level"]))
