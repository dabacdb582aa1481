"""Manifests and readiness snapshots: build, compare, merge, narrow, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = ("url", "size_bytes", "etag", "last_modified", "local_path", "mtime", "content_hash")


def manifest(files: DataFrame, host: str = "") -> DataFrame:
    """One entry for each of files (path, content, mtime): key relative to the host, size and MD5 of the bytes."""
    key = F.regexp_replace("path", "^" + host.replace(".", "\\.") + "/", "") if host else F.col("path")
    data = F.col("content").cast("binary")
    return files.select(key.alias("key"), F.octet_length(data).cast("bigint").alias("size_bytes"), F.col("mtime").cast("double").alias("mtime"), F.md5(data).alias("content_hash"), F.col("path").alias("local_path"))


def _changed(old: Column, new: Column) -> Column:
    """Sizes decide first, then equal times, then hashes if both are there; else it counts as changed."""
    field = lambda s, n: s[n]
    return (
        F.when(field(old, "size_bytes") != field(new, "size_bytes"), True)
        .when(F.coalesce(field(old, "mtime") == field(new, "mtime"), F.lit(False)), False)
        .when((F.coalesce(field(old, "content_hash"), F.lit("")) != "") & (F.coalesce(field(new, "content_hash"), F.lit("")) != ""), field(old, "content_hash") != field(new, "content_hash"))
        .otherwise(True)
    )


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change): added, modified or removed entries, by one full outer join."""
    side = lambda df, n: df.select("key", F.struct("size_bytes", "mtime", "content_hash").alias(n))
    both = side(old, "old").join(side(new, "new"), "key", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(_changed(F.col("old"), F.col("new")), "modified")
    return both.select("key", change.alias("change")).where("change is not null")


def narrow(diff: DataFrame, packed: DataFrame) -> DataFrame:
    """The diff on packed keys (column key); removals stay in any case."""
    kept = diff.where("change <> 'removed'").join(packed.select("key").distinct(), "key", "left_semi")
    return kept.unionByName(diff.where("change = 'removed'"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """New entries; etag and last_modified come from the old ones where the size is the same."""
    before = old.select("key", F.col("size_bytes").alias("_size"), F.col("etag").alias("_etag"), F.col("last_modified").alias("_modified"))
    same = F.col("_size") == F.col("size_bytes")
    joined = new.join(before, "key", "left")
    out = joined.withColumn("etag", F.when(same, F.col("_etag"))).withColumn("last_modified", F.when(same, F.col("_modified")))
    return out.drop("_size", "_etag", "_modified")


def gate(diff: DataFrame) -> bool:
    """Whether anything changed; stops at the first row."""
    return not diff.isEmpty()


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, change, old_score, new_score, old_grade, new_grade) of chunks that came, went, or changed score or grade."""
    side = lambda df, n: df.select("chunk_id", F.struct(F.col("score").alias("score"), F.col("grade").alias("grade")).alias(n))
    both = side(old, "o").join(side(new, "n"), "chunk_id", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when((F.col("o.score") != F.col("n.score")) | (F.col("o.grade") != F.col("n.grade")), "modified")
    return both.select("chunk_id", change.alias("change"), F.col("o.score").alias("old_score"), F.col("n.score").alias("new_score"), F.col("o.grade").alias("old_grade"), F.col("n.grade").alias("new_grade")).where("change is not null")


def drift_summary(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """One row: counts, averages of both sides and whether there is drift; no old side is a first run."""
    first = old is None
    old = new.limit(0) if old is None else old
    changes = drift(old, new).agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "removed")))
    avg = lambda df, n: df.agg(F.round(F.avg("score"), 6).alias(n))
    out = changes.crossJoin(avg(old, "old_avg")).crossJoin(avg(new, "new_avg"))
    return out.withColumn("has_drift", F.lit(first) | (F.col("added") + F.col("modified") + F.col("removed") > 0))


def render_drift(changes: DataFrame, old_avg: float | None, new_avg: float | None, first_run: bool = False) -> str:
    """The report as Markdown; ``changes`` is the result of :func:`drift`, as small as a report is."""
    rows = changes.orderBy("chunk_id").collect()
    of = {c: [r for r in rows if r["change"] == c] for c in ("added", "modified", "removed")}
    show = lambda v: "n/a" if v is None else f"{v:.2f}"
    average = f"average {show(old_avg)} → {show(new_avg)}"
    head = ", ".join(f"{len(v)} {k}" for k, v in of.items()) if rows or first_run else "no drift"
    lines = ["<!-- paperloom-drift -->", "## Drift of the context", ""] + ["First run: all chunks are new.", ""] * first_run + [f"**{head}**; {average}"]
    for name, own in of.items():
        if not own:
            continue
        lines += ["", f"### {name.capitalize()} ({len(own)})", ""]
        for r in own:
            if name == "modified":
                lines.append(f"- `{r['chunk_id']}`: {r['old_grade']} → {r['new_grade']}, {r['old_score']:.2f} → {r['new_score']:.2f} ({r['new_score'] - r['old_score']:+.2f})")
            else:
                side = "new" if name == "added" else "old"
                lines.append(f"- `{r['chunk_id']}`: {r[side + '_grade']}, {r[side + '_score']:.2f}")
    return "\n".join(lines)


def render_drift_text(changes: DataFrame, old_avg: float | None, new_avg: float | None, first_run: bool = False, delta: DataFrame | None = None) -> str:
    """The report as plain text, with the source files of a delta manifest (what, name) if there is one."""
    rows = changes.orderBy("chunk_id").collect()
    show = lambda v: "n/a" if v is None else f"{v:.2f}"
    lines = ["Drift of the context", "first run, all chunks are new"][: 1 + first_run]
    lines.append(("no drift" if not rows and not first_run else ", ".join(f"{sum(r['change'] == c for r in rows)} {c}" for c in ("added", "modified", "removed"))) + f"; average {show(old_avg)} -> {show(new_avg)}")
    for r in sorted(rows, key=lambda r: ("added", "modified", "removed").index(r["change"])):
        sides = [f"{r[s + '_grade']} {show(r[s + '_score'])}" for s in ("old", "new") if r[s + "_grade"] is not None]
        lines.append(f"  {r['change']:<9}{r['chunk_id']}  {' -> '.join(sides)}")
    if delta is not None:
        files = delta.where(F.col("what").isin("added", "modified", "removed")).orderBy("what", "name").collect()
        lines += ["Source files"] + [f"  {r['what']:<9}{r['name']}" for r in files] if files else ["No source file changed"]
    return "\n".join(lines)
