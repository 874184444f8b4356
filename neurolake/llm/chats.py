"""Chat formatting with tool-call linking (operator 10)."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from neurolake.llm import _frames

#: turns in a part of a conversation, and messages or calls in a piece of a part
PART = 1024
#: brackets within brackets of JSON that is read; a call or result that nests deeper counts as unreadable
DEPTH = 64

_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value: object) -> str:
    """JSON of one spelling: sorted keys, no spaces, no escapes but the needed ones."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _no_constant(name: str) -> float:
    raise ValueError(f"{name} is not JSON")


def read(text: str) -> object:
    """The JSON value of text. ValueError if it isn't JSON (NaN isn't), can't be written again as UTF-8, or nests deeper than DEPTH."""
    depth, quoted, escaped = 0, False, False
    for c in re.finditer(r'[\[\]{}"\\]', text) if text.count("[") + text.count("{") > DEPTH else ():
        if quoted:
            # a backslash takes the character after it along
            if escaped and c.start() == escape_at + 1:
                escaped = False
            elif c.group() == "\\":
                escaped, escape_at = True, c.start()
            elif c.group() == '"':
                quoted = False
            continue
        if c.group() == '"':
            quoted, escaped = True, False
        elif c.group() in "[{":
            depth += 1
            if depth > DEPTH:
                raise ValueError("nested too deep")
        else:
            depth -= 1
    value = json.loads(text, parse_constant=_no_constant)
    canonical(value).encode()
    return value


def check_schema(schema: dict, at: str = "$") -> None:
    """ValueError for a schema that invalid() can't apply."""
    kinds = schema.get("type")
    for k in [] if kinds is None else [kinds] if isinstance(kinds, str) else kinds:
        if k not in _TYPES:
            raise ValueError(f"{at}: unknown type {k}")
    for name, part in [*schema.get("properties", {}).items(), *([("[]", schema["items"])] if isinstance(schema.get("items"), dict) else [])]:
        check_schema(part, f"{at}.{name}")


def invalid(value: object, schema: dict, at: str = "$") -> list[str]:
    """What in value breaks the schema: type, enum, required, properties, additionalProperties, items, minimum, maximum."""
    kinds = schema.get("type")
    if kinds is not None:
        allowed = [kinds] if isinstance(kinds, str) else list(kinds)
        if not any(isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in allowed):
            return [f"{at}: not {' or '.join(allowed)}"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: under minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: over maximum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += invalid(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, x in enumerate(value):
            out += invalid(x, schema["items"], f"{at}[{i}]")
    return out


def _named(value: object) -> set[str]:
    """Ids of the calls whose results a value names as {"$result": id}."""
    out, todo = set(), [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if isinstance(v.get("$result"), str):
                out.add(v["$result"])
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return out


def calls_in(text: str | None) -> tuple[list[dict], int]:
    """(tool calls of an assistant's text in order, how many can't be read). A call: id, name, arguments (None where they aren't an object), needs."""
    out, bad = [], 0
    for body in _CALL.findall(text or ""):
        try:
            x = read(body)
            if not isinstance(x, dict) or not isinstance(x.get("id"), str):
                raise ValueError("a call needs an id")
        except (ValueError, RecursionError):
            bad += 1
            continue
        args = x.get("arguments")
        if isinstance(args, str):
            try:
                args = read(args)
            except (ValueError, RecursionError):
                args = None
        name = x.get("name")
        out.append({"id": x["id"], "name": name if isinstance(name, str) else canonical(name), "arguments": args if isinstance(args, dict) else None, "needs": sorted(_named(args))})
    return out, bad


def result_of(text: str | None) -> tuple[str, str] | None:
    """(call id, content) of a tool message, JSON with tool_call_id and content; None if it can't be read."""
    try:
        x = read(text or "")
    except (ValueError, RecursionError):
        return None
    if not isinstance(x, dict) or not isinstance(x.get("tool_call_id"), str):
        return None
    c = x.get("content")
    return x["tool_call_id"], c if isinstance(c, str) else canonical(c)


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left with the other columns of right, joined by keys, null for null."""
    r = right.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    got = left.join(r, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], how)
    return got.select(*[c for c in got.columns if c not in {f"_{k}" for k in keys}])


def _time() -> Column:
    """turn; a null turn stands first."""
    return F.coalesce("turn", F.lit(-(1 << 63)))


def parse_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, m, calls, result_id, content, bad) of the messages that hold calls, results or unreadable ones of these."""
    kind = "array<struct<id:string,name:string,arguments:string,needs:array<string>>>"
    shape = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("needs", pa.list_(pa.string()))]))

    def parse(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        calls, ids, contents, bads = [], [], [], []
        for role, text in zip(_frames.text_column(batch, "role").to_pylist(), _frames.text_column(batch).to_pylist()):
            found, bad = calls_in(text) if role == "assistant" and text and "<tool_call>" in text else ([], 0)
            calls.append([c | {"arguments": None if c["arguments"] is None else canonical(c["arguments"])} for c in found])
            got = result_of(text) if role == "tool" else None
            bads.append(bad + (role == "tool" and got is None))
            ids.append(got and got[0])
            contents.append(got and got[1])
        return {"calls": pa.array(calls, shape), "result_id": pa.array(ids, pa.string()), "content": pa.array(contents, pa.string()), "bad": pa.array(bads, pa.int64())}

    marked = messages.withColumn("m", F.xxhash64("role", "text"))
    parsed = _frames.add_columns(marked, [("calls", kind), ("result_id", "string"), ("content", "string"), ("bad", "long")], parse, ["conv_id", "turn", "m"])
    return _frames.cut(parsed.where("size(calls) > 0 or result_id is not null or bad > 0"))


def link_calls(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, orphans) of parse_messages(). calls: (conv_id, turn, pos, id, name, arguments JSON, needs, result); orphans: (conv_id, turn, id).

    A call has the first result of its id in the conversation at or after its turn, null where there is none; of results of one
    turn the least content. Results of an id are brought together before the hash join on (conv_id, id), one row to one call; the
    calls of an id that is called again find theirs by a running window. An orphan is a result that no call stands before.
    """
    calls = parsed.select("conv_id", "turn", _time().alias("t"), "m", F.posexplode("calls").alias("nth", "c")).select("conv_id", "turn", "t", F.struct("t", "m", "nth").alias("pos"), "c.*")
    results = parsed.where("result_id is not null").select("conv_id", "turn", _time().alias("t"), F.col("result_id").alias("id"), "content")
    ids = _frames.cut(calls.groupBy("conv_id", "id").agg(F.count("*").alias("n"), F.min("t").alias("t0")))
    told = _frames.cut(_same(results, ids, ["conv_id", "id"]))
    orphans = told.where("t0 is null or t < t0").select("conv_id", "turn", "id")
    good = told.where("t >= t0")
    first = good.where("n = 1").groupBy("conv_id", "id").agg(F.min(F.struct("t", "content")).alias("r")).select("conv_id", "id", F.col("r.content").alias("result"))
    counted = _same(calls, ids.select("conv_id", "id", "n"), ["conv_id", "id"])
    names = ["conv_id", "turn", "pos", "id", "name", "arguments", "needs"]
    once = _same(counted.where("n = 1").select(*names), first, ["conv_id", "id"]).select(*names, "result")
    # from the last turn back: at a turn results come before calls, the least content last
    lines = counted.where("n > 1").select(*names, "t", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("content"))
    heard = good.where("n > 1").select("conv_id", "id", "t", F.lit(1).alias("kind"), "content")
    back = W.partitionBy("conv_id", "id").orderBy(F.desc("t"), F.desc("kind"), F.desc("content"), F.desc("pos")).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = lines.unionByName(heard, allowMissingColumns=True).withColumn("result", F.last("content", ignorenulls=True).over(back))
    return once.unionByName(both.where("kind = 0").select(*names, "result")), orphans


def order_calls(calls: DataFrame) -> DataFrame:
    """calls (conv_id, pos, id, needs, ...) with key, depth, cyclic: sorted by (cyclic, key, depth, pos), every call comes after the calls it needs.

    A need is the first call of the id in the conversation; needs without a call don't count. key is the last position among a
    call and all that it needs, directly or not, so a call stays in its place unless it needs something later. Calls on or behind
    a cycle are cyclic and stand last, by position. Conversations in which nothing points ahead are in order as they are; in
    the others calls are settled in rounds, joins of the edges that are left, as many as the longest chain.
    """
    place = _frames.cut(calls.groupBy("conv_id", "id").agg(F.min("pos").alias("at")))
    edges = calls.select("conv_id", "pos", F.explode("needs").alias("id"))
    edges = _frames.cut(_same(edges, place, ["conv_id", "id"], "inner").select("conv_id", "pos", "at").distinct())
    ahead = edges.where("at >= pos").select("conv_id").distinct()
    if ahead.isEmpty():
        return calls.withColumn("key", F.col("pos")).withColumn("depth", F.lit(0)).withColumn("cyclic", F.lit(False))
    left = _frames.cut(_same(edges, ahead, ["conv_id"], "left_semi"))
    nodes = _same(calls.select("conv_id", "pos"), ahead, ["conv_id"], "left_semi")
    waits = left.select("conv_id", "pos").distinct().withColumn("waits", F.lit(True))
    state = _same(nodes, waits, ["conv_id", "pos"]).select("conv_id", "pos", F.col("pos").alias("key"), F.lit(0).alias("depth"), F.col("waits").isNull().alias("done"))
    state, before = _frames.cut(state), -1
    while (now := state.where("done").count()) != before:
        before = now
        needed = state.select("conv_id", F.col("pos").alias("at"), F.col("key").alias("their_key"), F.col("depth").alias("their_depth"), F.col("done").alias("their_done"))
        ready = _same(left, needed, ["conv_id", "at"]).groupBy("conv_id", "pos").agg(F.min("their_done").alias("ready"), F.max("their_key").alias("their_key"), F.max("their_depth").alias("their_depth"))
        turn = ~F.col("done") & F.col("ready")
        state = _frames.cut(
            _same(state, ready, ["conv_id", "pos"]).select(
                "conv_id", "pos", F.when(turn, F.greatest("key", "their_key")).otherwise(F.col("key")).alias("key"),
                F.when(turn, F.col("their_depth") + 1).otherwise(F.col("depth")).alias("depth"), (F.col("done") | turn).alias("done"),
            )
        )
    out = _same(calls, state, ["conv_id", "pos"])
    settled = F.coalesce("done", F.lit(True))
    return out.withColumn("key", F.when(settled, F.coalesce("key", "pos")).otherwise(F.col("pos"))).withColumn("depth", F.when(settled, F.coalesce("depth", F.lit(0))).otherwise(0)).withColumn("cyclic", ~settled).drop("done")


COUNTS = ["n_messages", "n_calls", "n_linked", "n_invalid", "n_dropped", "n_orphans"]


def format_chats(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, part, piece, counts, cyclic, json): a row for each conversation, part of PART turns and piece of PART messages or calls.

    Messages come in order of (turn, role, text); a row that repeats a whole message counts once. Calls stand after the
    messages in topological order with their results, null where missing, and what in the arguments breaks the schema of the
    tool; a tool without a schema takes any object, arguments that aren't an object are invalid. Calls and results that can't be
    read (not JSON, no id, nested over DEPTH) stay in their message and count in n_dropped. A null conversation id is a
    conversation, a null turn stands first, in part 0, null text is JSON null. Parts and pieces keep a conversation of any length
    from meeting in one task; calls are linked and ordered across them, and stand in the part of the last turn they depend on.
    A schema with a type that isn't known is a ValueError. cyclic: whether a call of the row is on or behind a cycle.
    """
    known = schemas or {}
    for name, schema in known.items():
        check_schema(schema, name)
    _frames.ready(conversations.sparkSession)
    messages = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    parsed = parse_messages(messages)
    calls, orphans = link_calls(parsed)
    calls = order_calls(_frames.cut(calls))
    part_of = lambda t: F.coalesce(F.when(t > -(1 << 63), F.floor(t / PART)), F.lit(0)).cast("int")
    spot = ["conv_id", "part", "piece"]

    def pieces(rows: DataFrame, *order: str) -> DataFrame:
        w = W.partitionBy("conv_id", "part").orderBy(*order)
        return rows.withColumn("piece", F.floor((F.row_number().over(w) - 1) / PART).cast("int"))

    said = pieces(messages.withColumn("part", part_of(_time())), "turn", "role", "text")
    said = said.groupBy(*spot).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    made = pieces(calls.withColumn("part", part_of(F.col("key.t"))), "cyclic", "key", "depth", "pos")
    made = made.groupBy(*spot).agg(F.sort_array(F.collect_list(F.struct("cyclic", "key", "depth", "pos", "id", "name", "arguments", "result"))).alias("calls"))
    of_part = lambda rows, value, name: rows.groupBy("conv_id", part_of(_time()).alias("part")).agg(value.alias(name)).withColumn("piece", F.lit(0))
    whole = said
    for other in (made, of_part(orphans, F.count("*"), "n_orphans"), of_part(parsed.where("bad > 0"), F.sum("bad"), "n_dropped")):
        r = other.select(*[F.col(c).alias(f"_{c}") if c in spot else F.col(c) for c in other.columns])
        j = whole.join(r, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in spot], "full")
        here = F.coalesce("part", "_part")
        whole = j.select(F.when(F.col("part").isNull(), F.col("_conv_id")).otherwise(F.col("conv_id")).alias("conv_id"), here.alias("part"), F.coalesce("piece", "_piece").alias("piece"), *[c for c in j.columns if c not in spot and c[1:] not in spot])

    def add(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out: dict[str, list] = {k: [] for k in ("n_messages", "n_calls", "n_linked", "n_invalid", "cyclic", "json")}
        for said, made in zip(_frames.text_column(batch, "messages").to_pylist(), _frames.text_column(batch, "calls").to_pylist()):
            said, made = said or [], made or []
            shown = []
            for c in made:
                args = None if c["arguments"] is None else json.loads(c["arguments"])
                wrong = ["$: not an object"] if args is None else invalid(args, known.get(c["name"], {}))
                shown.append({"arguments": args, "errors": wrong, "id": c["id"], "name": c["name"], "result": c["result"]})
            body: dict = {"messages": [{"content": m["text"], "role": m["role"]} for m in said]}
            if shown:
                body["tool_calls"] = shown
            out["n_messages"].append(len(said))
            out["n_calls"].append(len(shown))
            out["n_linked"].append(sum(c["result"] is not None for c in shown))
            out["n_invalid"].append(sum(bool(c["errors"]) for c in shown))
            out["cyclic"].append(any(c["cyclic"] for c in made))
            out["json"].append(canonical(body))
        return {k: pa.array(v, pa.string() if k == "json" else pa.bool_() if k == "cyclic" else pa.int64()) for k, v in out.items()}

    fields = [("n_messages", "long"), ("n_calls", "long"), ("n_linked", "long"), ("n_invalid", "long"), ("cyclic", "boolean"), ("json", "string")]
    done = _frames.add_columns(whole, fields, add, [*spot, "n_orphans", "n_dropped"])
    return done.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_orphans", "n_dropped")}).select(*spot, *COUNTS, "cyclic", "json")


# The tables hold no tool calls, so the query lets every assistant call two tools: count, of its text's length, and echo. Each
# user message is also the result of the count before it, and that at turns 2, 6, .. of the echo too. At turns 1, 5, .. count needs echo, which
# stands after it, and in every fifth conversation echo needs count as well. Every seventh conversation has a broken call in each message.
SCHEMAS = {
    "count": {"type": "object", "required": ["length"], "properties": {"length": {"type": "integer", "maximum": 400}}},
    "echo": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}}, "additionalProperties": False},
}


def with_tools(conversations: DataFrame) -> DataFrame:
    """conversations with calls and results made of their rows."""
    said = conversations.select("conv_id", "turn", "role", "text")
    made = said.selectExpr(
        "conv_id", "turn", "role",
        """CASE WHEN role = 'assistant' THEN concat(text,
            '<tool_call>{"name": "count", "id": "a', turn, '", "arguments": {"length": ', length(text), CASE WHEN turn % 4 = 1 THEN concat(', "after": {"$result": "b', turn, '"}') ELSE '' END, '}}</tool_call>',
            '<tool_call>{"name": "echo", "id": "b', turn, '", "arguments": {"text": "n', length(text), '"', CASE WHEN turn % 4 = 1 AND conv_id % 5 = 0 THEN concat(', "after": {"$result": "a', turn, '"}') ELSE '' END, '}}</tool_call>',
            CASE WHEN conv_id % 7 = 3 THEN '<tool_call>{"name": </tool_call>' ELSE '' END) ELSE text END AS text""",
    )
    users = said.where("role = 'user'")
    counted = users.selectExpr("conv_id", "turn", "'tool' AS role", """concat('{"content": {"n": ', length(text), '}, "tool_call_id": "a', turn - 1, '"}') AS text""")
    echoed = users.where("turn % 4 = 2").selectExpr("conv_id", "turn", "'tool' AS role", """concat('{"content": "ok", "tool_call_id": "b', turn - 1, '"}') AS text""")
    return made.unionByName(counted).unionByName(echoed)


def op10_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in canonical JSON, with calls and results made of their rows linked, ordered and validated."""
    return format_chats(with_tools(_frames.table(spark, sf_dir, "conversations")), SCHEMAS)


OP10_SQL = r"""
WITH c AS (SELECT DISTINCT conv_id, turn, role, text, length(text) AS n FROM conversations),
m AS (
  SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN text
      || '<tool_call>{"name": "count", "id": "a' || turn || '", "arguments": {"length": ' || n || CASE WHEN turn % 4 = 1 THEN ', "after": {"$result": "b' || turn || '"}' ELSE '' END || '}}</tool_call>'
      || '<tool_call>{"name": "echo", "id": "b' || turn || '", "arguments": {"text": "n' || n || '"' || CASE WHEN turn % 4 = 1 AND conv_id % 5 = 0 THEN ', "after": {"$result": "a' || turn || '"}' ELSE '' END || '}}</tool_call>'
      || CASE WHEN conv_id % 7 = 3 THEN '<tool_call>{"name": </tool_call>' ELSE '' END ELSE text END AS text FROM c
  UNION ALL SELECT conv_id, turn, 'tool', '{"content": {"n": ' || n || '}, "tool_call_id": "a' || (turn - 1) || '"}' FROM c WHERE role = 'user'
  UNION ALL SELECT conv_id, turn, 'tool', '{"content": "ok", "tool_call_id": "b' || (turn - 1) || '"}' FROM c WHERE role = 'user' AND turn % 4 = 2),
js AS (
  SELECT conv_id, count(*) AS n_messages, string_agg('{"content":' || to_json(text) || ',"role":' || to_json(role) || '}', ',' ORDER BY turn, role, text) AS body FROM m GROUP BY conv_id),
calls AS (
  SELECT a.conv_id, a.turn, t.tool, a.turn % 4 = 1 AND a.conv_id % 5 = 0 AS cyclic, a.n,
         CASE WHEN t.tool = 'a' THEN '{"n":' || u.n || '}' WHEN u.turn % 4 = 2 THEN 'ok' END AS result
  FROM c a CROSS JOIN (VALUES ('a'), ('b')) AS t(tool) LEFT JOIN c u ON u.conv_id = a.conv_id AND u.turn = a.turn + 1 AND u.role = 'user' WHERE a.role = 'assistant'),
shown AS (
  SELECT *, CASE WHEN tool = 'a' AND n > 400 THEN '"$.length: over maximum"' WHEN tool = 'b' AND cyclic THEN '"$.after: unknown"' END AS wrong,
         CASE WHEN tool = 'a' THEN '{' || CASE WHEN turn % 4 = 1 THEN '"after":{"$result":"b' || turn || '"},' ELSE '' END || '"length":' || n || '}'
              ELSE '{' || CASE WHEN cyclic THEN '"after":{"$result":"a' || turn || '"},' ELSE '' END || '"text":"n' || n || '"}' END AS arguments,
         CASE WHEN turn % 4 = 1 AND NOT cyclic AND tool = 'b' THEN 0 WHEN tool = 'a' THEN 1 ELSE 2 END AS nth FROM calls),
k AS (
  SELECT conv_id, count(*) AS n_calls, count(result) AS n_linked, count(wrong) AS n_invalid, bool_or(cyclic) AS cyclic,
         string_agg('{"arguments":' || arguments || ',"errors":[' || coalesce(wrong, '') || '],"id":"' || tool || turn || '","name":"' || CASE tool WHEN 'a' THEN 'count' ELSE 'echo' END || '","result":' || coalesce(to_json(result), 'null') || '}', ',' ORDER BY cyclic, turn, nth) AS body
  FROM shown GROUP BY conv_id),
o AS (
  SELECT u.conv_id, sum(CASE WHEN a.turn IS NULL THEN CASE WHEN u.turn % 4 = 2 THEN 2 ELSE 1 END ELSE 0 END) AS n_orphans
  FROM c u LEFT JOIN c a ON a.conv_id = u.conv_id AND a.turn = u.turn - 1 AND a.role = 'assistant' WHERE u.role = 'user' GROUP BY u.conv_id),
b AS (SELECT conv_id, count(*) AS n FROM c WHERE role = 'assistant' AND conv_id % 7 = 3 GROUP BY conv_id)
SELECT js.conv_id, CAST(0 AS INTEGER) AS part, CAST(0 AS INTEGER) AS piece, n_messages, CAST(coalesce(n_calls, 0) AS BIGINT) AS n_calls, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked,
       CAST(coalesce(n_invalid, 0) AS BIGINT) AS n_invalid, CAST(coalesce(b.n, 0) AS BIGINT) AS n_dropped, CAST(coalesce(n_orphans, 0) AS BIGINT) AS n_orphans, coalesce(cyclic, false) AS cyclic,
       '{"messages":[' || js.body || ']' || coalesce(',"tool_calls":[' || k.body || ']', '') || '}' AS json
FROM js LEFT JOIN k USING (conv_id) LEFT JOIN o USING (conv_id) LEFT JOIN b USING (conv_id)
"""

QUERIES = {"op10_chats": op10_chats}
SQL = {"op10_chats": OP10_SQL}
