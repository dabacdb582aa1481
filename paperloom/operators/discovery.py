"""What to fetch and keep: URL scope, llms.txt and sitemap parsing, cascade choice, shell pages, ignore rules."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SUFFIXES = "7z avi bin bmp bz2 dll dmg eot exe gif gz ico jpeg jpg mov mp3 mp4 ogg otf pdf png rar so svg tar tiff ttf wasm wav webm webp woff woff2 zip"
MAX_SITEMAP_DEPTH, LAYER_MINIMUM = 3, 3
SHELL_SHARE, SHELL_CHARS, SHELL_SMALL_SITE = 0.7, 200, 5


def is_binary(path: Column) -> Column:
    """The extension is one of data that is no text."""
    return F.regexp_extract(F.lower(path), r"\.([^./]+)$", 1).isin(*_SUFFIXES.split())


def ignore_regex(pattern: str) -> tuple[bool, str] | None:
    """(negated, Java regex over relative paths) of a line of an ignore file; None for blanks and comments."""
    line = pattern.rstrip("\n")
    if not line.endswith("\\ "):
        line = line.rstrip(" ")
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:].removeprefix("\\") if line[negated:].startswith(("\\#", "\\!")) else line[negated:]
    folder = line.endswith("/")
    body = line.rstrip("/")
    if not body:
        return None
    rooted = "/" in body
    body = body.removeprefix("/")
    steps, out = body.split("/"), ""
    for i, step in enumerate(steps):
        last = i == len(steps) - 1
        if step == "**":
            out += ".+" if last else "(?:[^/]+/)*"
            continue
        part, j = "", 0
        while j < len(step):
            c = step[j]
            close = step.find("]", j + 2) if c == "[" else -1
            if c == "*":
                part += "[^/]*"
            elif c == "?":
                part += "[^/]"
            elif close > 0:
                inside = step[j + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
                part += "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]"
                j = close
            elif c == "\\" and j + 1 < len(step):
                j += 1
                part += re.escape(step[j])
            else:
                part += re.escape(c)
            j += 1
        out += part + ("" if last else "/")
    return negated, ("^" if rooted else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$")


def ignored(path: Column, patterns: list[str]) -> Column:
    """The last pattern that matches ignores the path, or, negated, keeps it."""
    out = F.lit(False)
    for parsed in filter(None, map(ignore_regex, patterns)):
        negated, regex = parsed
        out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def filter_files(files: DataFrame, patterns: list[str], skip_binary: bool = True) -> DataFrame:
    """Files (path, ...) that are neither binary nor ignored; the predicate reaches the scan."""
    kept = files.where(~is_binary(F.col("path"))) if skip_binary else files
    return kept.where(~ignored(F.col("path"), patterns))


def host(url: Column) -> Column:
    """Host and port as they stand; letter case counts."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def segments(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


def _base(base_url: str) -> tuple[str, str, int]:
    parts = urlsplit(base_url)
    prefix = parts.path.rstrip("/") + "/"
    return parts.netloc, prefix, len([s for s in prefix.split("/") if s])


def in_scope(url: Column, base_url: str, depth: int = 0) -> Column:
    """http(s), the base's host, a path under the base's, and at most ``depth`` more steps (0: any number)."""
    netloc, prefix, own = _base(base_url)
    slashed = F.concat(F.regexp_replace(url_path(url), "/+$", ""), F.lit("/"))
    near = (segments(url_path(url)) - own <= depth) if depth > 0 else F.lit(True)
    return url.rlike("^(?i:https?)://") & (host(url) == netloc) & slashed.startswith(prefix) & near


def filter_urls(urls: DataFrame, base_url: str, depth: int = 0) -> DataFrame:
    """(url, pos): URLs (url, pos) in scope, each once at its first place."""
    return urls.where(in_scope(F.col("url"), base_url, depth)).groupBy("url").agg(F.min("pos").alias("pos"))


def sub_sitemap_in_scope(url: Column, base_url: str) -> Column:
    """The host is the base's, or the folder of the sitemap's path is under the base's path."""
    netloc, prefix, _ = _base(base_url)
    folder = F.concat(F.regexp_replace(F.regexp_extract(url_path(url), "^(.*)/[^/]*$", 1), "/+$", ""), F.lit("/"))
    return (host(url) == netloc) | folder.startswith(prefix)


def llms_links(bodies: DataFrame) -> DataFrame:
    """(source, url, pos): links of llms.txt bodies (source, body) in order, each once for a source.

    A line that starts with ``#`` is skipped; another gives its Markdown links, or itself if it is a URL.
    """
    line = bodies.select("source", F.posexplode(F.split("body", "\r?\n")).alias("row", "line")).where("not trim(line) like '#%'")
    found = F.regexp_extract_all("line", F.lit(r"\[[^\]]*\]\((https?://[^)\s]+)\)"), 1)
    bare = F.regexp_extract_all("line", F.lit(r"^\s*(https?://\S+)\s*$"), 1)
    urls = line.select("source", "row", F.posexplode(F.concat(found, bare)).alias("col", "url"))
    first = urls.groupBy("source", "url").agg(F.min(F.struct("row", "col")).alias("at"))
    return first.select("source", "url", (F.col("at.row").cast("bigint") * 100000 + F.col("at.col")).alias("pos"))


def sitemap_urls(bodies: DataFrame, roots: DataFrame, base_url: str) -> DataFrame:
    """(url): pages that the sitemaps (url, body) list, from ``roots`` (url) on through indexes three deep.

    Every sitemap is read once, so a cycle of indexes ends; sub-sitemaps outside the scope are left out.
    """
    locs = lambda root: F.expr(f"xpath(body, '/{root}/*/loc/text()')")
    parsed = bodies.select(F.col("url").alias("map"), F.transform(locs("urlset"), lambda x: F.trim(x)).alias("pages"), F.transform(locs("sitemapindex"), lambda x: F.trim(x)).alias("subs"))
    front, seen, found = roots.select(F.col("url").alias("map")).distinct(), None, None
    for depth in range(MAX_SITEMAP_DEPTH + 1):
        here = parsed.join(front, "map", "left_semi")
        pages = here.select(F.explode("pages").alias("url"))
        found = pages if found is None else found.union(pages)
        seen = front if seen is None else seen.union(front)
        if depth < MAX_SITEMAP_DEPTH:
            front = here.select(F.explode("subs").alias("map")).where(sub_sitemap_in_scope(F.col("map"), base_url)).distinct().join(seen, "map", "left_anti")
    return found.where("url <> ''").distinct()


def cascade(layers: DataFrame, least: int = LAYER_MINIMUM) -> DataFrame:
    """(layer, url) of the first layer with ``least`` or more distinct URLs; no rows if none has."""
    full = layers.groupBy("layer").agg(F.count_distinct("url").alias("n")).where(F.col("n") >= least)
    return layers.select("layer", "url").distinct().join(full.agg(F.min("layer").alias("layer")), "layer", "left_semi")


def is_shell_site(pages: DataFrame) -> DataFrame:
    """One row (pages, shells, shell_site) of pages (visible, app_root): more than 70 % empty shells, or any on a site of under five pages."""
    shell = (F.col("visible") < SHELL_CHARS) | F.col("app_root")
    out = pages.agg(F.count("*").alias("pages"), F.count_if(shell).alias("shells"))
    few = F.col("pages") < SHELL_SMALL_SITE
    return out.withColumn("shell_site", F.when(few, F.col("shells") > 0).otherwise(F.col("shells") / F.col("pages") > SHELL_SHARE))


def frontier_crawl(pages: DataFrame, start: str, base_url: str, depth: int) -> DataFrame:
    """(url, level): pages of a stored table (url, targets) reached from ``start`` within ``depth`` steps on one host."""
    level = pages.sparkSession.createDataFrame([(start,)], "url string").withColumn("level", F.lit(0))
    seen = level
    for step in range(1, depth + 1):
        out = pages.join(level.select("url"), "url", "left_semi").select(F.explode("targets").alias("t")).select(F.regexp_replace("t", "#.*$", "").alias("url"))
        level = out.where(host(F.col("url")) == _base(base_url)[0]).distinct().join(seen.select("url"), "url", "left_anti").withColumn("level", F.lit(step))
        seen = seen.union(level)
    return seen.join(pages.select("url"), "url", "left_semi")
