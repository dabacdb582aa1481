"""Structural blocks, sub-chunks and boundary faults of one text, as Arrow functions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_ITEM = re.compile(r"\s*(?:[-*+]|\d+\.)\s")
_PRE = re.compile(r"<pre[\s>]|</pre>", re.I)


def _kind(p: str) -> str:
    if p.lstrip().startswith("```"):
        return "fence" if sum(line.strip().startswith("```") for line in p.split("\n")) < 2 else ""
    low = p.lower()
    if "<pre" in low and "</pre>" not in low:
        return "pre"
    if _ITEM.match(p):
        return "list"
    return "table" if p.strip().startswith("|") else ""


_ENDS = {"fence": lambda p: p.rstrip().endswith("```"), "pre": lambda p: "</pre>" in p.lower()}
_RUNS = {"list": lambda p: bool(_ITEM.match(p)), "table": lambda p: p.strip().startswith("|")}


def structural_blocks(paragraphs: list[str]) -> list[str]:
    """Paragraphs that belong together made one: an open fence or ``<pre>`` to its end, runs of list items and table rows."""
    out, i = [], 0
    while i < len(paragraphs):
        kind, j = _kind(paragraphs[i]), i + 1
        if kind in _ENDS:
            while j < len(paragraphs) and not _ENDS[kind](paragraphs[j]):
                j += 1
            j = min(j + 1, len(paragraphs))
        elif kind:
            while j < len(paragraphs) and _RUNS[kind](paragraphs[j]):
                j += 1
        out.append("\n\n".join(paragraphs[i:j]))
        i = j
    return out


def split_by_words(text: str | None, limit: int) -> list[tuple[str, int]]:
    """(piece, offset) pairs of at most ``limit`` words where blocks allow; the whole text for no limit."""
    if not text or limit <= 0:
        return [(text or "", 0)]
    out, held, words, at, start = [], [], 0, 0, 0
    for block in structural_blocks(text.split("\n\n")):
        n = len(block.split())
        if held and words + n > limit:
            out.append(("\n\n".join(held), start))
            held, words, start = [], 0, at
        held.append(block)
        words += n
        at += len(block) + 2
    return [*out, ("\n\n".join(held), start)]


def _line(text: str, at: int) -> dict:
    row = text.count("\n", 0, at)
    return {"line": row + 1, "snippet": text.split("\n")[row]}


def boundary_issues(text: str | None) -> list[dict]:
    """The last of an odd number of fences; the first ``<pre>`` or ``</pre>`` left alone if counts differ."""
    text, out = text or "", []
    fences = [m.start() for m in re.finditer("```", text)]
    if len(fences) % 2:
        out.append({"kind": "code_fence", **_line(text, fences[-1])})
    open_, alone, balance = [], [], 0
    for m in _PRE.finditer(text):
        closing = m.group().startswith("</")
        balance += -1 if closing else 1
        if not closing:
            open_.append(m.start())
        elif open_:
            open_.pop()
        else:
            alone.append(m.start())
    if balance:
        out.append({"kind": "pre_tag", **_line(text, open_[0] if balance > 0 else alone[0])})
    return out


def subchunks(text: Column, limit: int) -> Column:
    """Array of (text, char_offset)."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("char_offset", pa.int64())]))

    def run(column: pa.Array) -> pa.Array:
        return pa.array([[{"text": p, "char_offset": o} for p, o in split_by_words(t, limit)] for t in column.to_pylist()], kind)

    return F.arrow_udf(run, "array<struct<text:string,char_offset:bigint>>")(text)


@F.udtf(returnType="piece: int, char_offset: bigint, text: string")
class SubchunkRows:
    """``SELECT * FROM subchunks(text, limit)``: the pieces of one text as rows; a null text has one empty piece."""

    def eval(self, text: str, limit: int):
        for piece, (own, offset) in enumerate(split_by_words(text, limit or 0)):
            yield piece, offset, own


def issues(text: Column) -> Column:
    """Array of (kind, line, snippet)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("line", pa.int32()), ("snippet", pa.string())]))

    def run(column: pa.Array) -> pa.Array:
        return pa.array([boundary_issues(t) for t in column.to_pylist()], kind)

    return F.arrow_udf(run, "array<struct<kind:string,line:int,snippet:string>>")(text)


def intact(text: Column) -> Column:
    """Fences are even and ``<pre>`` tags balanced; stays in Catalyst. Tags are looked for only in a text that has a ``<``."""
    fences, opened, closed = marks(text)
    return (fences % 2 == 0) & (opened == closed)


def marks(text: Column) -> tuple[Column, Column, Column]:
    """Fences, ``<pre>`` and ``</pre>`` of a text; null for a null."""
    fences = F.length(F.replace(text, F.lit("```"), F.lit("```x"))) - F.length(text)
    count = lambda p: F.when(F.contains(text, F.lit("<")), F.regexp_count(text, F.lit(p))).when(text.isNotNull(), F.lit(0))
    return fences, count(r"(?i)<pre[\s>]"), count("(?i)</pre>")


def structural(text: Column) -> Column:
    """Array of the structural blocks of a text."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([structural_blocks((t or "").split("\n\n")) for t in column.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)
