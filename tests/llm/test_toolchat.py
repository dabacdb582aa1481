import json

from paperloom.llm import toolchat as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n_calls string"
TOOLS = {"add": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {}}, "required": ["a", "b"], "additionalProperties": False}}


def call(cid, args, **more):
    return {"id": cid, "name": "add", "arguments": args, **more}


def message(*calls, content="x"):
    return json.dumps({"content": content, "tool_calls": list(calls)})


def result(cid, content):
    return json.dumps({"tool_call_id": cid, "content": content})


def linked(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return {r.conv_id: r for r in T.link_tool_calls(df, TOOLS).collect()}


def test_links_orders_and_validates(spark):
    rows = [
        (1, 0, "user", "héllo"),
        (1, 1, "assistant", message(call("c2", {"a": 1, "b": "$c1"}), call("c1", '{"b": 2.0, "a": 1}'))),
        (1, 2, "tool", result("c1", {"z": 1, "a": [1.50, 2.0]})),
        (1, 3, "tool", result("c2", 3)),
        (1, 4, "tool", result("c9", "nobody asked")),
    ]
    row = linked(spark, rows)[1]
    body = json.loads(row.json)
    assert [c["id"] for c in body["tool_calls"]] == ["c1", "c2"]
    assert body["tool_calls"][0] == {"arguments": {"a": 1, "b": 2}, "errors": [], "id": "c1", "name": "add", "result": {"a": [1.5, 2], "z": 1}}
    assert body["unmatched_results"] == ["c9"]
    assert (row.n_messages, row.n_calls, row.n_linked, row.n_valid) == (5, 2, 2, 2)
    assert row.json == T.canonical(body) and "é" in row.json and ": " not in row.json


def test_errors_stay_beside_calls(spark):
    rows = [
        (1, 0, "assistant", message(call("p", {"a": "no"}, depends_on=["q"]), call("q", {"a": 1, "b": 1, "c": 1}, depends_on=["p"]), {"id": "u", "name": "other", "arguments": {}}, call("u", {}), {"no": "id"})),
        (1, 1, "tool", result("p", None)),
    ]
    row = linked(spark, rows)[1]
    every = json.loads(row.json)["tool_calls"]
    assert [c["id"] for c in every] == ["u", "u", None, "p", "q"] and row.n_calls == 5
    assert every[1]["errors"] == ["$.a: required", "$.b: required", "id: repeated", "result: missing"]
    assert every[2] == {"arguments": {"no": "id"}, "errors": ["call: malformed", "result: missing"], "id": None, "name": None, "result": None}
    calls = {c["id"]: c for c in reversed(every)}
    assert calls["p"]["errors"] == ["$.b: required", "$.a: type", "depends_on: cycle"]
    assert calls["q"]["errors"] == ["$.c: additionalProperties", "depends_on: cycle", "result: missing"]
    assert calls["u"]["errors"] == ["name: unknown tool", "id: repeated", "result: missing"]


def test_repeated_ids_are_paired_by_turn(spark):
    rows = [(1, t, "assistant", message(call("c", {"a": t, "b": 0}))) for t in (1, 3, 5)]
    rows += [(1, 4, "tool", result("c", "of 3")), (1, 4, "tool", result("c", "of 3, late")), (1, 6, "tool", result("c", "of 5")), (1, 0, "tool", result("c", "early"))]
    rows += [(1, 4, "assistant", message(call("d", {"a": 1, "b": "$c"})))]
    calls = json.loads(linked(spark, rows)[1].json)["tool_calls"]
    assert [(c["id"], c["arguments"]["a"], c["result"]) for c in calls] == [("c", 1, "early"), ("c", 3, "of 3"), ("d", 1, None), ("c", 5, "of 5")]


def test_numbers_and_white_space(spark):
    huge = "1" + "0" * 400
    rows = [
        (1, 0, "assistant", '\n\t\r {"tool_calls": [{"id": "c", "name": "add", "arguments": {"a": %s, "b": 1.5}}]}' % huge),
        (1, 1, "tool", '\n{"tool_call_id": "c", "content": %s}' % huge),
        (2, 0, "assistant", message(call("c", {"a": 1.5, "b": 1}))),
        (3, 0, "assistant", "\u00a0" + message(call("c", {}))),
    ]
    got = linked(spark, rows)
    assert (got[1].n_linked, got[1].n_valid) == (1, 1) and huge in got[1].json
    assert json.loads(got[2].json)["tool_calls"][0]["errors"] == ["$.a: type", "result: missing"]
    assert got[3].n_calls == 0
    assert T.violations(10**400, {"type": "integer", "maximum": 1e300}) == ["$: maximum"]


def test_odd_rows(spark):
    deep = "{" + '"a":[' * 100000
    rows = [(None, None, None, None), (None, None, None, None), (2, 1, "assistant", '{"tool_calls": 3}'), (2, 0, "user", deep), (2, 1, "user", ""), (3, 0, "tool", '{"x": NaN}')]
    got = linked(spark, rows)
    assert got[None].n_messages == 1 and json.loads(got[None].json)["messages"] == [{"content": None, "role": None, "turn": None}]
    assert got[2].n_messages == 3 and json.loads(got[2].json)["messages"][0]["content"] == deep
    assert [m["content"] for m in json.loads(got[2].json)["messages"][1:]] == ['{"tool_calls": 3}', ""]
    assert json.loads(got[3].json)["messages"][0]["content"] == '{"x": NaN}'
    assert T.link_tool_calls(spark.createDataFrame([], SCHEMA), TOOLS).count() == 0


def test_topological_order_against_definition():
    import random

    for seed in range(50):
        rng = random.Random(seed)
        ids = [f"c{i}" for i in range(8)]
        calls = [{"call_id": c, "turn": rng.randrange(3), "place": i, "needs": rng.sample(ids, rng.randrange(3)) if rng.random() < 0.5 else []} for i, c in enumerate(ids)]
        out = T.ordered(calls)
        assert sorted(c["call_id"] for c, _ in out) == ids
        place = {c["call_id"]: k for k, (c, _) in enumerate(out)}
        for c, cyclic in out:
            assert cyclic or all(place[n] < place[c["call_id"]] for n in c["needs"] if n != c["call_id"])


def test_canonical_numbers_and_keys():
    assert T.canonical({"b": 1.0, "a": [True, None, 0.5], "\U0001f600": 1, "￿": 2}) == '{"a":[true,null,0.5],"b":1,"\U0001f600":1,"￿":2}'


def test_whole_table(spark):
    import duckdb

    from paperloom.llm.queries import ORACLE_SQL, op2_chat_formatting

    rows = sorted(op2_chat_formatting(spark, "/root/testdata/sf0.001").collect())
    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = con.sql(f"SELECT conv_id, n_messages, n_calls, n_linked, n_valid, json FROM ({ORACLE_SQL['op2_chat_formatting']}) ORDER BY ALL").fetchall()
    assert [tuple(r) for r in rows] == want
    assert 0 < sum(r.n_valid for r in rows) < sum(r.n_linked for r in rows) < sum(r.n_calls for r in rows)
    for r in rows:
        assert T.canonical(json.loads(r.json)) == r.json
