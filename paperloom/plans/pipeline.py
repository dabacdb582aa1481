"""The pack plan: configuration, presets, validation, and the stages as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import word_count
from paperloom.operators import blockdedup, chunking, linkgraph, readiness, retrieval
from paperloom.session import shuffled, written
from paperloom.sources import artifacts, writers

PRESETS: dict[str, dict[str, Any]] = {
    "notebooklm": {"bundle": "notebooklm", "strategy": "semantic", "max_chunks": 50, "max_words": 400_000, "context_header": True, "score": True, "dedup": "both"},
    "rag": {"strategy": "size", "format": "jsonl", "context_header": True, "cross_refs": True, "score": True, "dedup": "both"},
    "claude-project": {"strategy": "semantic", "max_words": 100_000, "context_header": True, "score": True, "dedup": "both"},
}


@dataclass(frozen=True)
class PackConfig:
    """What a pack run does; :meth:`resolve` merges explicit values, a file's and defaults."""

    strategy: str = "size"
    format: str = "md"
    max_words: int = 500_000
    max_chunks: int = 50
    bundle: str = ""
    dedup: str = ""
    dedup_threshold: int = 3
    block_delimiter: str = "\n\n"
    context_header: bool = False
    cross_refs: bool = False
    score: bool = False
    report: bool = False
    dry_run: bool = False
    with_index: bool = False
    prefix: str = "docs_chunk_"

    @classmethod
    def preset(cls, name: str, **more: Any) -> PackConfig:
        if name not in PRESETS:
            raise ValueError(f"unknown preset {name!r}")
        return cls(**{**PRESETS[name], **more})

    @classmethod
    def resolve(cls, explicit: dict[str, Any], file: dict[str, Any] | None = None) -> PackConfig:
        """Explicit values win over those of a file, these over defaults; names may have hyphens; unknown ones of a file are ignored."""
        known = {f.name for f in fields(cls)}
        low = {k.replace("-", "_"): v for k, v in (file or {}).items()}
        low["max_words"] = low.get("max_words", low.pop("max_words_per_chunk", cls.max_words))
        return cls(**{**{k: v for k, v in low.items() if k in known}, **explicit})

    def validated(self, queries: bool = False) -> PackConfig:
        """The configuration with what follows from its flags, or an error."""
        if self.format not in writers.FORMATS:
            raise ValueError(f"format {self.format!r} isn't supported; use md, txt or jsonl")
        if self.strategy not in ("size", "semantic"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if queries and self.strategy == "semantic":
            raise ValueError("packing for queries needs the strategy size")
        if self.report and self.dry_run:
            raise ValueError("a dry run has no final text to report on")
        out = replace(self, score=True) if self.report else self
        if self.bundle == "notebooklm":
            out = replace(out, max_chunks=min(out.max_chunks, 50), max_words=min(out.max_words, 500_000))
        return out


@dataclass(frozen=True)
class Packed:
    """The results of a run as lazy tables; those that the configuration doesn't ask for are None."""

    texts: DataFrame
    members: DataFrame
    pieces: DataFrame
    bodies: DataFrame | None
    scores: DataFrame | None
    edges: DataFrame | None
    urls: DataFrame | None
    #: One row of :func:`paperloom.sources.artifacts.pack_summary`: limits that are passed are told, nothing is dropped.
    summary: DataFrame


def pack(pages: DataFrame, config: PackConfig, queries: DataFrame | None = None, manifest: DataFrame | None = None, overrides: DataFrame | None = None) -> Packed:
    """Packs pages (path, raw_text, text, headings, links): dedup, order, chunk, score, link, annotate, render.

    With a manifest records and headers name the original URL; ``overrides`` (path, text) replace texts. A dry run
    scores as if no boundary were broken and renders nothing.
    """
    config = config.validated(queries is not None)
    texts = pages.select("path", "text")
    texts = artifacts.with_overrides(texts, overrides) if overrides is not None else texts.withColumn("text", F.coalesce("text", F.lit("")))
    if config.dedup:
        # everything below reads it: sizes, pieces, boundaries
        texts = written(blockdedup.deduplicate(texts, config.dedup, config.dedup_threshold, config.block_delimiter), "pack-texts")
    sized = texts.select("path", word_count(F.col("text")).alias("words"))
    if config.strategy == "semantic":
        members = chunking.chunk_by_directory(sized, config.max_words)
    elif queries is None:
        members = chunking.chunk_by_size(sized, config.max_words)
    else:
        order = retrieval.query_order(texts.select(F.col("path").alias("doc_id"), "text"), queries).select(F.col("doc_id").alias("path"), "seq")
        members = chunking.chunk_by_size(sized.join(order, "path"), config.max_words, ["seq"])
    if config.bundle:
        members = chunking.balance(members, config.max_chunks, config.max_words)
    members = written(members, "pack-members")
    scores = edges = None
    if config.score:
        facts = pages.select("path", word_count(F.col("raw_text")).alias("raw_words"), word_count(F.col("text")).alias("extracted_words"), F.coalesce(F.size("headings"), F.lit(0)).alias("headings"), F.coalesce(F.array_max(F.transform("headings", lambda h: h["level"])), F.lit(0)).alias("max_level"))
        seen = texts.select("path", *readiness.boundary_counts(F.lit("") if config.dry_run else F.col("text")))
        scores = readiness.score_chunks(members, facts.join(shuffled(seen), "path"))
    shown = texts
    if config.cross_refs:
        edges = linkgraph.edges(linkgraph.link_table(pages.select("path", "links")), members)
        if not config.dry_run:
            shown = linkgraph.annotated_pages(texts, edges, config.prefix)
    urls = artifacts.original_urls(pages, manifest) if manifest is not None else None
    named = shown.join(shuffled(members.select("path", "chunk")), "path").join(shuffled(pages.select("path", "headings")), "path")
    cut = writers.pieces(named, config.max_words if config.context_header or config.score else 0)
    bodies = None if config.dry_run else writers.chunk_bodies(cut, config.format, config.context_header, config.with_index, urls, scores)
    return Packed(texts, members, cut, bodies, scores, edges, urls, artifacts.pack_summary(members, None, config.max_chunks, config.max_words))
