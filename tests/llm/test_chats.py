"""Tool calls linked, ordered, validated; odd JSON; the query against SQL."""

from __future__ import annotations

import json
import os

import duckdb
import pytest

from neurolake.llm import chats

SCHEMA = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"


def call(i, name, args):
    return f"<tool_call>{json.dumps({'id': i, 'name': name, 'arguments': args})}</tool_call>"


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def need(i):
    return {"x": {"$result": i}}


def test_chats(spark):
    rows = [
        (1, 0, "user", "add"),
        (1, 1, "assistant", call("c2", "add", {"a": {"$result": "c1"}, "b": 2}) + call("c1", "add", {"a": 1, "b": "x"})),
        (1, 2, "tool", result("c1", {"z": 1, "a": "é"})),
        (1, 3, "tool", result("zz", "lost")),
        (1, 0, "user", "add"),
        (2, 0, "assistant", call("p", "f", need("q")) + call("q", "f", need("p")) + call("r", "f", need("q")) + call("s", "f", {})),
        (3, 5000, "user", "late"),
        (3, 1, None, None),
        (None, None, "user", "no id"),
        (None, None, "assistant", call("n", "f", {})),
        (None, 4, "tool", result("n", "found")),
        (4, 0, "assistant", "<tool_call>not json</tool_call>"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    schema = {"add": {"type": "object", "required": ["a", "b"], "properties": {"b": {"type": "number"}}}}
    got = {(r["conv_id"], r["part"]): r for r in chats.format_chats(df, schema).collect()}
    one = got[(1, 0)]
    assert (one["n_messages"], one["n_calls"], one["n_linked"], one["n_invalid"], one["n_orphans"], one["n_dropped"], one["cyclic"]) == (4, 2, 1, 1, 1, 0, False)
    body = json.loads(one["json"])
    assert [c["id"] for c in body["tool_calls"]] == ["c1", "c2"] and body["tool_calls"][0]["result"] == '{"a":"é","z":1}'
    assert one["json"] == chats.canonical(body)
    assert got[(2, 0)]["cyclic"] and [c["id"] for c in json.loads(got[(2, 0)]["json"])["tool_calls"]] == ["s", "p", "q", "r"]
    assert set(got) == {(1, 0), (2, 0), (3, 0), (3, 4), (None, 0), (4, 0)} and got[(4, 0)]["n_dropped"] == 1
    assert (got[(None, 0)]["n_linked"], got[(None, 0)]["n_messages"]) == (1, 3)
    assert chats.format_chats(df.limit(0)).count() == 0


def test_odd_json_neither_crashes_nor_vanishes(spark):
    deep = "[" * 200_000
    odd = [deep, deep + "]" * 200_000, "NaN", '{"id": "a", "arguments": {"x": NaN}}', '{"id": 7}', '{"id": "\\ud800"}', "1e999", '{"id": "n", "arguments": {"x": 1e999}}', "9" * 5000, ""]
    rows = [(1, k, "assistant", f"<tool_call>{x}</tool_call>") for k, x in enumerate(odd)]
    rows += [(1, 50 + k, "tool", x) for k, x in enumerate([deep, '{"tool_call_id": 3}', "", '{"tool_call_id": "a", "content": NaN}'])]
    rows += [(2, 0, "assistant", '<tool_call>{"id": "k", "arguments": "' + "[" * 500 + '"}</tool_call>' + call("s", None, {"t": "[" * 300 + '\\"{'}))]
    got = {r["conv_id"]: r for r in chats.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1]["n_calls"], got[1]["n_dropped"], got[1]["n_messages"]) == (0, len(odd) + 4, len(odd) + 4)
    assert (got[2]["n_calls"], got[2]["n_invalid"], got[2]["n_dropped"]) == (2, 1, 0)
    assert json.loads(got[1]["json"])["messages"][0]["content"].count("[") == 200_000
    with pytest.raises(ValueError):
        chats.format_chats(spark.createDataFrame([], SCHEMA), {"f": {"properties": {"x": {"type": "text"}}}})
    assert chats.invalid({"a": True, "b": [1, "x"]}, {"properties": {"a": {"enum": [1]}, "b": {"items": {"type": "integer"}}}}) == ["$.a: not in enum", "$.b[1]: not integer"]


def test_repeated_ids_and_order_across_parts(spark):
    rows = [(1, t, "assistant", call("same", "f", {"t": t})) for t in range(0, 400, 10)] + [(1, t, "tool", result("same", str(t))) for t in (5, 5, 95, 95, 300)] + [(1, 300, "tool", result("same", "0"))]
    rows += [(2, 0, "assistant", call("a", "f", need("c")) + call("b", "f", {})), (2, 3000, "assistant", call("c", "f", need("b")) + call("d", "f", need("a"))), (2, 9000, "assistant", call("e", "f", need("e")) + call("g", "f", need("e")))]
    rows += [(3, 7, "user", f"message {k}") for k in range(2500)]
    got = {(r["conv_id"], r["part"], r["piece"]): r for r in chats.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    linked = {c["arguments"]["t"]: c["result"] for c in json.loads(got[(1, 0, 0)]["json"])["tool_calls"]}
    first = lambda t: min([(r, c) for r, c in ((5, "5"), (95, "95"), (300, "0")) if r >= t], default=(0, None))[1]
    assert linked == {t: first(t) for t in range(0, 400, 10)}
    ids = {k: [c["id"] for c in json.loads(r["json"]).get("tool_calls", [])] for k, r in got.items() if k[0] == 2}
    assert ids == {(2, 0, 0): ["b"], (2, 2, 0): ["c", "a", "d"], (2, 8, 0): ["e", "g"]} and got[(2, 8, 0)]["cyclic"]
    assert sorted((k[2], r["n_messages"]) for k, r in got.items() if k[0] == 3) == [(0, 1024), (1, 1024), (2, 452)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_matches_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = duck.execute(chats.OP10_SQL).df()
    got = chats.op10_chats(spark, SF).toPandas()[list(want.columns)]
    want, got = (x.sort_values("conv_id").reset_index(drop=True) for x in (want, got))
    assert want.equals(got.astype(want.dtypes.to_dict())), want.compare(got)
    assert (want[["n_calls", "n_linked", "n_invalid", "n_orphans", "n_dropped"]].sum() > 0).all() and want["cyclic"].any()
