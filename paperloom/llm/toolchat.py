"""Chats with tool calls: linked, ordered, validated and written as canonical JSON.

A message whose text is a JSON object with a list ``tool_calls`` holds calls
``{"id", "name", "arguments", "depends_on"?}`` (arguments as an object or as JSON text) besides an
optional ``content``; a message with role ``tool`` whose text is a JSON object with ``tool_call_id``
holds a result ``{"tool_call_id", "content"}``. Any other text is ordinary content.

Calls and results of a conversation are hash-joined by identifier; where an identifier is used again,
a result belongs to the last call of it at or before the result's turn. A call comes after the calls that
it names in ``depends_on`` or whose ``$id`` is one of its argument strings; ties go by turn, place
and id. Arguments are checked against the JSON schema of the tool (type, enum, const, required,
properties, additionalProperties, items, minimum, maximum, minLength, maxLength, minItems, maxItems,
pattern). JSON is canonical: keys in UTF-16 order, no white space, no escapes that aren't needed,
whole floats as integers.
"""

from __future__ import annotations

import bisect
import heapq
import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import written

#: An object's brace after the white space of JSON.
_OPENS = r"^[ \t\r\n]*\{"
_PART = "kind string, place int, call_id string, name string, arguments string, needs array<string>, body string"
_PARTS = f"array<struct<{', '.join(f'{a}:{b}' for a, b in (p.split(' ', 1) for p in _PART.split(', ')))}>>"


def _plain(value: Any) -> Any:
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return {k: _plain(value[k]) for k in keys}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() and abs(value) < 1e21 else value


def canonical(value: Any) -> str:
    """The one text of a JSON value; lone surrogates become question marks."""
    out = json.dumps(_plain(value), ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    return out.encode("utf-8", "replace").decode("utf-8")


def _refuse(name: str) -> None:
    raise ValueError(name)


def _finite(text: str) -> float:
    value = float(text)
    if value - value != 0:
        raise ValueError(text)
    return value


def parsed(text: str | None) -> dict | None:
    """The JSON object that the whole text is, or None; NaN, infinities and numbers beyond floats are no JSON."""
    if text is None or not text.lstrip(" \t\r\n").startswith("{"):
        return None
    try:
        value = json.loads(text, parse_constant=_refuse, parse_float=_finite)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _references(value: Any) -> list[str]:
    if isinstance(value, str):
        return [value[1:]] if value.startswith("$") and len(value) > 1 else []
    if isinstance(value, dict):
        value = list(value.values())
    return [r for v in value for r in _references(v)] if isinstance(value, list) else []


def parts(role: str | None, text: str | None) -> list[dict] | None:
    """The calls or the result in a message and its remaining content; None for an ordinary message, or one nested too deep to be written."""
    try:
        return _parts_of(role, parsed(text))
    except RecursionError:
        return None


def _parts_of(role: str | None, whole: dict | None) -> list[dict] | None:
    if whole is None:
        return None
    if role == "tool" and isinstance(whole.get("tool_call_id"), str):
        return [{"kind": "result", "place": 0, "call_id": whole["tool_call_id"], "body": canonical(whole.get("content"))}]
    if not isinstance(whole.get("tool_calls"), list):
        return None
    out = [{"kind": "content", "place": 0, "body": canonical(whole.get("content"))}]
    for place, call in enumerate(whole["tool_calls"]):
        if not isinstance(call, dict) or not isinstance(call.get("id"), str):
            out.append({"kind": "broken", "place": place, "arguments": canonical(call), "needs": []})
            continue
        arguments = call.get("arguments", {})
        if isinstance(arguments, str):
            inner = parsed(arguments)
            arguments = arguments if inner is None else inner
        needs = call.get("depends_on")
        needs = [n for n in needs if isinstance(n, str)] if isinstance(needs, list) else []
        name = call.get("name")
        out.append({"kind": "call", "place": place, "call_id": call["id"], "name": name if isinstance(name, str) else None, "arguments": canonical(arguments), "needs": sorted({*needs, *_references(arguments)})})
    return out


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: Any, kind: str) -> bool:
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if kind == "number":
        return number
    if kind == "integer":
        return number and (isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES.get(kind, ()))


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What of the schema the value breaks, as ``path: rule``, in order."""
    out = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: type"]
    same = canonical(value)
    if "enum" in schema and same not in map(canonical, schema["enum"]):
        out.append(f"{at}: enum")
    if "const" in schema and same != canonical(schema["const"]):
        out.append(f"{at}: const")
    if _is(value, "number"):
        out += [f"{at}: {rule}" for rule, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    if isinstance(value, str):
        out += [f"{at}: {rule}" for rule, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", len(value))), ("pattern", "pattern" in schema and not re.search(schema["pattern"], value))) if bad]
    if isinstance(value, list):
        out += [f"{at}: {rule}" for rule, bad in (("minItems", len(value) < schema.get("minItems", 0)), ("maxItems", len(value) > schema.get("maxItems", len(value)))) if bad]
        for k, item in enumerate(value):
            out += violations(item, schema.get("items", {}), f"{at}[{k}]")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{name}: required" for name in schema.get("required", []) if name not in value]
        for name in sorted(value):
            if name in own:
                out += violations(value[name], own[name], f"{at}.{name}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{name}: additionalProperties")
    return out


def ordered(calls: list[dict]) -> list[tuple[dict, bool]]:
    """The calls in topological order and whether each lies on or behind a cycle; those come last.

    A need binds to the last call of that id before the call itself, in the order of (turn, place, id), or,
    if there is none, to the first after it; needs that name no other call order nothing. Ties go by that
    order.
    """
    calls = sorted(calls, key=lambda c: (c["turn"] is not None, c["turn"] or 0, c["place"], c["call_id"] or "", c.get("name") or "", c.get("arguments") or ""))
    places: dict[str, list[int]] = {}
    for k, c in enumerate(calls):
        if c["call_id"] is not None:
            places.setdefault(c["call_id"], []).append(k)
    needs: list[set[int]] = []
    for k, c in enumerate(calls):
        bound = set()
        for n in c["needs"]:
            at = places.get(n, [])
            before = bisect.bisect_left(at, k)
            later = before + (before < len(at) and at[before] == k)
            if before:
                bound.add(at[before - 1])
            elif later < len(at) and n != c["call_id"]:
                bound.add(at[later])
        needs.append(bound)
    after: dict[int, list[int]] = {}
    for own, others in enumerate(needs):
        for n in others:
            after.setdefault(n, []).append(own)
    ready = [k for k in range(len(calls)) if not needs[k]]
    out, seen = [], set()
    while ready:
        own = heapq.heappop(ready)
        out.append((calls[own], False))
        seen.add(own)
        for n in after.get(own, []):
            needs[n].discard(own)
            if not needs[n]:
                heapq.heappush(ready, n)
    return out + [(c, True) for k, c in enumerate(calls) if k not in seen]


def _linked(rows: list[dict]) -> tuple[int, int, int, list, list]:
    """(calls, linked, valid, the calls in order with their results and errors, ids of results without a call) of a conversation."""
    out, linked, valid = [], 0, 0
    for row, cyclic in ordered([r for r in rows if r["is_call"]]):
        body = row["body"]
        errors = [*row["errors"], *["depends_on: cycle"] * cyclic, *["id: repeated"] * (row["times"] > 1), *["result: missing"] * (body is None)]
        linked += body is not None
        valid += not errors
        out.append({"id": row["call_id"], "name": row["name"], "arguments": json.loads(row["arguments"]), "result": None if body is None else json.loads(body), "errors": errors})
    return len(out), linked, valid, out, sorted(r["call_id"] for r in rows if not r["is_call"])


def _checked(schemas: dict[str, dict]):
    """The violations of each call's arguments."""

    def run(is_call: pa.Array, call_id: pa.Array, name: pa.Array, arguments: pa.Array) -> pa.Array:
        out = []
        for call, cid, tool, text in zip(is_call.to_pylist(), call_id.to_pylist(), name.to_pylist(), arguments.to_pylist(), strict=True):
            if not call:
                out.append([])
            elif cid is None:
                out.append(["call: malformed"])
            else:
                out.append(["name: unknown tool"] if tool not in schemas else violations(json.loads(text), schemas[tool]))
        return pa.array(out, pa.list_(pa.string()))

    return run


_TOLD = pa.struct([("n_calls", pa.int64()), ("n_linked", pa.int64()), ("n_valid", pa.int64()), ("json", pa.string())])


def _serialise(messages: pa.Array, calls: pa.Array) -> pa.Array:
    out = []
    for own, rows in zip(messages.to_pylist(), calls.to_pylist(), strict=True):
        texts = [{"role": m["role"], "turn": m["turn"], "content": m["text"] if m["body"] is None else json.loads(m["body"])} for m in own]
        n_calls, n_linked, n_valid, linked, orphans = _linked(rows or [])
        out.append({"n_calls": n_calls, "n_linked": n_linked, "n_valid": n_valid, "json": canonical({"messages": texts, "tool_calls": linked, "unmatched_results": orphans})})
    return pa.array(out, _TOLD)


def _parts(role: pa.Array, text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("place", pa.int32()), ("call_id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("needs", pa.list_(pa.string())), ("body", pa.string())]))
    return pa.array([parts(r, t) for r, t in zip(role.to_pylist(), text.to_pylist(), strict=True)], kind)


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, n_messages, n_calls, n_linked, n_valid, json): one row for each conversation.

    ``messages`` has (conv_id, turn, role, text); other columns are not looked at. Messages are in
    order of turn, nulls first, then role and text; repeated rows count as one message. A null
    conv_id is a conversation of its own; a null text is a null content. Calls that share an id are all
    kept and marked ``id: repeated``; of results for one call the first counts; results for an id that no
    call has are listed under ``unmatched_results``. A call that is no object with a string id is kept,
    without id, as ``call: malformed``. Texts that only look like JSON stay as they are. Calls with
    errors are kept, the errors beside them. No rows give no rows. A conversation is one row of the
    result, so its messages must fit in one value of Spark (2 GB).
    """
    rows = messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    looks = F.col("text").rlike(_OPENS)
    rows = rows.withColumn("parts", F.when(looks, F.arrow_udf(_parts, _PARTS)("role", F.when(looks, F.col("text")))))
    rows = written(rows, "chat-rows")  # messages and calls are both made of it
    part = rows.where("parts is not null").select("conv_id", "turn", "role", "text", F.explode("parts").alias("p")).select("conv_id", "turn", "role", "text", "p.*").where("kind <> 'content'")
    part = part.withColumn("whole", F.xxhash64("role", "text")).drop("role", "text").distinct().drop("whole")  # repeated messages count once
    known, is_call = F.col("turn").isNotNull(), F.col("kind") == "call"
    same = Window.partitionBy("conv_id", "call_id")
    upto = same.orderBy(known, "turn", ~is_call, "place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    count = lambda w: F.sum(is_call.cast("int")).over(w)
    named = part.where("kind <> 'broken'").withColumn("times", count(same))
    nth = F.when(is_call, F.row_number().over(same.orderBy(~is_call, known, "turn", "place", "name", "arguments"))).otherwise(F.greatest(F.lit(1), count(upto)))
    named = named.withColumn("nth", nth)
    calls = named.where(is_call).select(F.struct("conv_id", "call_id", "nth").alias("k"), F.col("conv_id").alias("c_conv"), F.col("call_id").alias("c_id"), "turn", "place", "name", "arguments", "needs", "times", F.lit(True).alias("is_call"))
    results = named.where(~is_call).groupBy("conv_id", "call_id", "nth").agg(F.min(F.struct(known.alias("known"), "turn", "body")).alias("r"))
    results = results.select(F.struct("conv_id", "call_id", "nth").alias("rk"), F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id"), "r.body")
    both = calls.join(results.hint("shuffle_hash"), F.col("k").eqNullSafe(F.col("rk")), "full_outer")
    both = both.select(F.coalesce("c_conv", "r_conv").alias("conv_id"), F.coalesce("c_id", "r_id").alias("call_id"), "turn", "place", "name", "arguments", "needs", "times", "is_call", "body")
    broken = part.where("kind = 'broken'").withColumn("times", F.lit(1)).withColumn("is_call", F.lit(True))
    both = both.unionByName(broken.select(*both.columns))
    both = both.withColumn("errors", F.arrow_udf(_checked(schemas), "array<string>")("is_call", "call_id", "name", "arguments"))
    linked = both.groupBy(F.col("conv_id").alias("link_conv")).agg(F.collect_list(F.struct(*(c for c in both.columns if c != "conv_id"))).alias("calls"))
    body = F.get(F.filter("parts", lambda p: p["kind"].isin("content", "result")), 0)["body"]
    told = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text", body.alias("body")))).alias("messages"))
    told = told.join(linked, F.col("conv_id").eqNullSafe(F.col("link_conv")), "left")
    told = told.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"), F.arrow_udf(_serialise, "n_calls bigint, n_linked bigint, n_valid bigint, json string").asNondeterministic()("messages", "calls").alias("t"))
    return told.select("conv_id", "n_messages", "t.*")
