"""Named queries over a pack behind a JSON-RPC core."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import excerpt
from paperloom.operators import retrieval

PARSE, INVALID, NO_METHOD, BAD_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603
PROTOCOL = "2025-06-18"
#: Versions that are answered as they are asked for; any other gets PROTOCOL.
KNOWN_PROTOCOLS = (PROTOCOL, "2025-03-26", "2024-11-05")


class ToolError(Exception):
    """A fault of the caller, told in the result."""


@dataclass(frozen=True)
class Tool:
    """A named query."""

    name: str
    description: str
    schema: dict
    run: Callable[[dict], Any]


def pack_tools(pack: DataFrame, references: DataFrame | None = None, scores: DataFrame | None = None, prefix: str = "docs_chunk_") -> list[Tool]:
    """Tools over a pack (id, source, content, breadcrumb, readiness_grade), as pack readers give it."""
    spark = pack.sparkSession
    held: list[retrieval.Index] = []

    def index() -> retrieval.Index:
        """Built at the first search, read by all."""
        if not held:
            held.append(retrieval.Index.build(pack.select(F.col("id").alias("doc_id"), F.col("content").alias("text"))))
        return held[0]

    def text_of(args: dict, name: str) -> str:
        value = args.get(name)
        if not isinstance(value, str) or not value:
            raise ToolError(f"{name} must be a text")
        return value

    def search(args: dict) -> dict:
        k = args.get("k", 5)
        query = spark.createDataFrame([(0, text_of(args, "query"))], "query_id int, text string")
        try:
            retrieval.check_k(k)
            best = retrieval.search(pack.select(F.col("id").alias("doc_id"), F.col("content").alias("text")), query, k, index=index()).where("score > 0")
        except ValueError as fault:
            raise ToolError(str(fault)) from fault
        parent = F.concat(F.lit(prefix), F.split_part(F.col("doc_id"), F.lit("_"), F.lit(1)))
        rows = best.join(pack, F.col("doc_id") == F.col("id")).select("rank", "id", parent.alias("chunk_id"), "source", F.round("score", 4).alias("score"), "breadcrumb", F.col("readiness_grade").alias("grade"), excerpt(F.col("content")).alias("excerpt"))
        return {"results": [r.asDict(recursive=True) for r in rows.orderBy("rank").collect()]}

    def one(df: DataFrame | None, column: str, value: str) -> dict:
        row = None if df is None else df.where(F.col(column) == value).limit(1).collect()
        if not row:
            raise ToolError(f"nothing is known of {value!r}")
        return row[0].asDict(recursive=True)

    def readiness(args: dict) -> dict:
        if "chunk_id" in args:
            return one(scores, "chunk_id", text_of(args, "chunk_id"))
        if scores is None:
            raise ToolError("the pack has no scores")
        from paperloom.operators.readiness import summary

        return summary(scores).first().asDict()

    need = lambda *names: {"type": "object", "properties": {n: {"type": "string"} for n in names}, "required": list(names)}
    return [
        Tool("search_chunks", "Best records for a query by BM25.", {"type": "object", "properties": {"query": {"type": "string"}, "k": {"type": "integer", "minimum": 1}}, "required": ["query"]}, search),
        Tool("get_chunk", "One record by its id.", need("id"), lambda a: one(pack, "id", text_of(a, "id"))),
        Tool("get_cross_refs", "Chunks that a chunk refers to and that refer to it.", need("chunk_id"), lambda a: one(references, "chunk_id", text_of(a, "chunk_id"))),
        Tool("get_readiness", "The score of a chunk, or of all.", {"type": "object", "properties": {"chunk_id": {"type": "string"}}}, readiness),
    ]


class Server:
    """Answers JSON-RPC 2.0 messages; notifications get no answer and faults of tools don't end it."""

    def __init__(self, tools: Iterable[Tool], name: str = "paperloom", version: str = "1"):
        self.tools = {t.name: t for t in tools}
        self.info = {"name": name, "version": version}

    def handle_line(self, line: str) -> str | None:
        try:
            message = json.loads(line)
        except json.JSONDecodeError:
            return self._text(None, error=(PARSE, "no JSON"))
        return self.handle(message)

    @staticmethod
    def _text(ident: Any, result: Any = None, error: tuple[int, str] | None = None) -> str:
        body = {"error": {"code": error[0], "message": error[1]}} if error else {"result": result}
        return json.dumps({"jsonrpc": "2.0", "id": ident, **body}, ensure_ascii=False, default=str)

    def handle(self, message: Any) -> str | None:
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            return self._text(message.get("id") if isinstance(message, dict) else None, error=(INVALID, "no JSON-RPC 2.0 request"))
        if "id" not in message:
            return None
        ident, method, params = message["id"], message["method"], message.get("params", {})
        if not isinstance(params, dict):
            return self._text(ident, error=(BAD_PARAMS, "params must be an object"))
        try:
            if method == "initialize":
                return self._text(ident, {"protocolVersion": asked if (asked := params.get("protocolVersion")) in KNOWN_PROTOCOLS else PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": self.info})
            if method == "ping":
                return self._text(ident, {})
            if method == "tools/list":
                return self._text(ident, {"tools": [{"name": t.name, "description": t.description, "inputSchema": t.schema} for t in self.tools.values()]})
            if method != "tools/call":
                return self._text(ident, error=(NO_METHOD, f"no method {method!r}"))
            tool, args = self.tools.get(params.get("name")), params.get("arguments", {})
            if tool is None or not isinstance(args, dict):
                return self._text(ident, error=(BAD_PARAMS, "no such tool, or arguments that are no object"))
            try:
                content, bad = json.dumps(tool.run(args), ensure_ascii=False, default=str), False
            except ToolError as fault:
                content, bad = str(fault), True
            return self._text(ident, {"content": [{"type": "text", "text": content}], "isError": bad})
        except Exception as fault:  # the loop must survive any fault
            return self._text(ident, error=(INTERNAL, str(fault)[:200]))

    def serve(self, lines: Iterable[str], write: Callable[[str], Any]) -> None:
        """Answers lines until they end."""
        for line in lines:
            if line.strip() and (answer := self.handle_line(line)) is not None:
                write(answer + "\n")
