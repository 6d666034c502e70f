"""Chat messages with tool calls linked to their results, in canonical JSON.

An assistant's text may hold calls, `<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>`; a message of role `tool` holds one result,
`{"tool_call_id": ..., "content": ...}`. An argument of the form "$id" stands for the result of another call. Calls and results are
joined by conversation and identifier, calls are ordered so that each follows those whose results it takes, and arguments are validated against schemas.

Rows stay rows of messages: where a message belongs is told by columns to sort by, so that no conversation is gathered in one task.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweave.llm.common import drop_since, mark, new_path, stored

CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
REFERENCE = re.compile(r"\$([A-Za-z0-9_-]+)\Z")
LONE = re.compile("[\ud800-\udfff]")


def sound(text: str) -> str:
    """A text without halves of surrogate pairs, which JSON can spell but UTF-8 can't."""
    return LONE.sub("\ufffd", text)


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks, and numbers and strings in one form each; numbers that JSON lacks raise ValueError. Halves of surrogate pairs become U+FFFD."""

    def tidy(v: object) -> object:
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("not a JSON number")
            return int(v) if v.is_integer() and abs(v) < 2**53 else v
        if isinstance(v, dict):
            return {str(k): tidy(x) for k, x in v.items()}
        return [tidy(x) for x in v] if isinstance(v, list) else v

    return sound(json.dumps(tidy(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def faults(value: object, schema: dict, at: str = "$") -> list[str]:
    """How a value breaks a JSON schema: type, enum, required, properties, additionalProperties, items, minimum, maximum, minLength and maxLength are known. A reference to a result fits any type."""
    if isinstance(value, str) and REFERENCE.match(value):
        return []
    kind, out = schema.get("type"), []
    if kind in ("number", "integer"):
        good = isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    else:
        good = kind not in _TYPES or isinstance(value, _TYPES[kind])
    if not good:
        return [f"{at}: not {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: below minimum"] * ("minimum" in schema and value < schema["minimum"]) + [f"{at}: above maximum"] * ("maximum" in schema and value > schema["maximum"])
    if isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: lacks {k}" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}: unknown {k}" for k in sorted(set(value) - set(known))]
        for k in sorted(set(value) & set(known)):
            out += faults(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += faults(v, schema["items"], f"{at}[{i}]")
    return out


def _references(value: object) -> list[str]:
    if isinstance(value, str):
        return [m[1]] if (m := REFERENCE.match(value)) else []
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    return [r for v in inner for r in _references(v)]


def read_calls(text: str, schemas: dict[str, dict]) -> tuple[str, list[dict]]:
    """A text without its calls, and the calls: id, name, takes, arguments (canonical) and fault (null if valid)."""
    calls = []
    for m in CALL.finditer(text):
        call = {"id": None, "name": None, "takes": [], "arguments": None, "fault": None}
        try:
            body = json.loads(m[1])
            if not isinstance(body, dict):
                raise ValueError("not an object")
            call["id"], call["name"] = (None if body.get(k) is None else sound(str(body[k])) for k in ("id", "name"))
            given = body.get("arguments", {})
            call["arguments"] = canonical(given)
            call["takes"] = sorted(set(_references(given)))
            found = faults(given, {"type": "object"} | schemas.get(call["name"] or "", {}))
            if schemas and call["name"] not in schemas:
                found = [f"unknown tool {call['name']}", *found]
            if call["id"] is None:
                found = ["no id", *found]
            call["fault"] = sound("; ".join(found)) or None
        except (ValueError, RecursionError) as e:
            call["fault"] = f"not JSON: {type(e).__name__}"
        calls.append(call)
    return (CALL.sub("", text).strip() if calls else text), calls


def _read_result(text: str) -> tuple[str | None, str]:
    try:
        body = json.loads(text)
        if isinstance(body, dict) and body.get("tool_call_id") is not None:
            content = body.get("content")
            return sound(str(body["tool_call_id"])), sound(content) if isinstance(content, str) else canonical(content)
    except (ValueError, RecursionError):
        pass
    return None, text


_CALLS = "array<struct<id:string,name:string,takes:array<string>,arguments:string,fault:string>>"


def read_messages(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, turn, role, content, calls, answers) of every message; answers: the identifier that a tool message's result is for."""
    schemas = schemas or {}
    kinds = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("takes", pa.list_(pa.string())), ("arguments", pa.string()), ("fault", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, calls, answers = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                content, own, result = text, [], None
                if text is not None and role == "assistant" and "<tool_call>" in text:
                    content, own = read_calls(text, schemas)
                elif text is not None and role == "tool":
                    result, content = _read_result(text)
                contents.append(content)
                calls.append(own)
                answers.append(result)
            columns = [batch.column(c) for c in ("conv_id", "turn", "role")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(contents, pa.string()), pa.array(calls, kinds), pa.array(answers, pa.string())], names=["conv_id", "turn", "role", "content", "calls", "answers"])

    source = messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    return source.mapInArrow(run, f"conv_id bigint, turn bigint, role string, content string, calls {_CALLS}, answers string")


def order_calls(calls: DataFrame) -> DataFrame:
    """(conv_id, id, depth) of calls (conv_id, id, takes): 0 for those that take no call's result, else one more than the deepest that they take; null in or after a circle.

    Each level is a part of one written table, so that the plan of a long chain stays as short as that of a short one.
    """
    edges = stored(calls.select("conv_id", "id", F.explode("takes").alias("before")).join(calls.select("conv_id", F.col("id").alias("before")).distinct(), ["conv_id", "before"]), "chat-edges")
    ids = calls.select("conv_id", "id").distinct()
    if edges.isEmpty():
        return ids.withColumn("depth", F.lit(0))
    waiting = edges.select("conv_id", "id").distinct()
    new, root, paths = ids.join(waiting, ["conv_id", "id"], "left_anti").withColumn("depth", F.lit(0)), new_path(calls.sparkSession, "chat-depth"), []
    while True:
        paths.append(f"{root}/{len(paths)}")
        new.write.option("compression", "zstd").parquet(paths[-1])
        last = calls.sparkSession.read.schema(new.schema).parquet(paths[-1])
        if last.isEmpty():
            break
        done = calls.sparkSession.read.schema(new.schema).parquet(*paths)
        # A call is looked at when one that it takes has just been done, and is ready if all are; so a level costs what its calls take, however long the chain. Calls in a
        # circle never are ready, so the levels end.
        touched = edges.join(last.select("conv_id", F.col("id").alias("before")), ["conv_id", "before"]).select("conv_id", "id").distinct()
        takes = edges.join(touched, ["conv_id", "id"], "left_semi")
        ready = takes.join(done.select("conv_id", F.col("id").alias("before"), F.lit(1).alias("one")), ["conv_id", "before"], "left").groupBy("conv_id", "id").agg(F.min(F.coalesce("one", F.lit(0))).alias("all")).filter("all = 1")
        new = ready.select("conv_id", "id", F.lit(len(paths)).alias("depth"))
    done = calls.sparkSession.read.schema(new.schema).parquet(*paths)
    return ids.join(done, ["conv_id", "id"], "left")


def format_messages(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, turn, role, message, n_calls, n_answered, n_invalid, answers_turn, sort_turn, sort_depth) of every message.

    message: canonical JSON of role, content, and a message's tool_calls (id, name, arguments, by depth, then in their order) or tool_call_id. n_answered: calls with at least one result in the
    conversation; n_invalid: calls that aren't JSON, break their schema, lack an id, repeat an earlier one's, or have no depth (see order_calls). A tool message sorts
    right after the call it answers: by sort_turn (the call's turn, for others their own), then sort_depth (0 for others, 1 + the call's depth for results, those of calls without a depth after all others of the conversation), then
    turn. answers_turn is null for results without a call. An identifier belongs to its first call, by turn, place, name and arguments; of messages equal in all of these, each has it. Null roles and texts are JSON nulls; null conversations
    or turns are kept, and calls in null conversations are never answered. Repeated rows, and rows that repeat a conversation's turn, stay rows of their own; an empty table gives an empty one. Very long texts are read whole. Other columns are dropped.
    """
    spark, before = messages.sparkSession, mark()
    # Rows are numbered in the table as written, so that the numbers stay.
    read = stored(read_messages(messages, schemas).withColumn("row", F.monotonically_increasing_id()), "chat-read")
    calls = read.select("row", "conv_id", "turn", F.posexplode("calls").alias("place", "call")).select("row", "conv_id", "turn", "place", "call.*").filter("id IS NOT NULL")
    calls = calls.withColumn("body", F.struct("turn", "place", "name", "arguments", "takes"))
    first = calls.groupBy("conv_id", "id").agg(F.min("body").alias("body"))
    first = stored(first.join(order_calls(first.select("conv_id", "id", "body.takes")), ["conv_id", "id"]), "chat-calls")
    drop_since(spark, before, read, first)
    results = read.filter("answers IS NOT NULL").select("conv_id", F.col("answers").alias("id")).distinct()
    linked = first.join(results.withColumn("has", F.lit(True)), ["conv_id", "id"], "left").select("conv_id", "id", "body", "depth", F.coalesce("has", F.lit(False)).alias("has"))
    # What the calls of a message came to, by message; most messages have none and never meet the join's other side.
    verdicts = calls.select("row", "conv_id", "place", "id", "body").join(linked.withColumnRenamed("body", "owner"), ["conv_id", "id"])
    # A call that repeats its own message's identifier is another place, so not the owner.
    owns = F.col("body").eqNullSafe(F.col("owner"))
    verdict = F.struct((owns & F.col("has")).alias("answered"), (owns & F.col("depth").isNotNull()).alias("sound"), F.when(owns, F.col("depth")).alias("depth"))
    per = verdicts.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("place", verdict))).alias("v"))
    plain = read.filter(F.size("calls") == 0)
    calling = read.filter(F.size("calls") > 0).join(per, "row", "left")
    state = lambda i, name: F.coalesce(F.try_element_at("v", i)[name], F.lit(False))
    flags = F.transform("calls", lambda c, i: F.struct(state(i, "answered").alias("a"), (c["fault"].isNotNull() | ~state(i, "sound")).alias("x")))
    calling = calling.withColumn("flags", flags)
    empty = F.lit(0)
    calling = calling.withColumn("n_answered", F.size(F.filter("flags", lambda f: f["a"]))).withColumn("n_invalid", F.size(F.filter("flags", lambda f: f["x"])))
    # A call stands behind those whose results it takes; calls without a depth come last.
    placed = F.transform("calls", lambda c, i: F.struct(F.coalesce(F.try_element_at("v", i)["depth"], F.lit((1 << 31) - 1)).alias("depth"), i.alias("place"), c.alias("call")))
    calling = calling.withColumn("calls", F.transform(F.array_sort(placed), lambda p: p["call"])).drop("flags", "v")
    rest = plain.filter("answers IS NULL").withColumn("n_answered", empty).withColumn("n_invalid", empty)
    same = calling.unionByName(rest).withColumn("answers_turn", F.lit(None).cast("bigint")).withColumn("sort_turn", F.col("turn")).withColumn("sort_depth", F.lit(0))
    deepest = linked.groupBy("conv_id").agg(F.coalesce(F.max("depth"), F.lit(-1)).alias("deepest"))
    at = linked.join(deepest, "conv_id").select("conv_id", F.col("id").alias("answers"), F.lit(True).alias("known"), F.col("body.turn").alias("answers_turn"), F.coalesce("depth", F.col("deepest") + 1).alias("depth"))
    tools = plain.filter("answers IS NOT NULL").withColumn("n_answered", empty).withColumn("n_invalid", empty).join(at, ["conv_id", "answers"], "left")
    tools = tools.withColumn("sort_turn", F.coalesce("answers_turn", "turn")).withColumn("sort_depth", F.when(F.col("known"), F.col("depth") + 1).otherwise(0)).drop("depth", "known")
    every = same.unionByName(tools)
    return _serialized(every)


def _serialized(rows: DataFrame) -> DataFrame:
    """Messages as canonical JSON."""
    names = ["conv_id", "turn", "role", "message", "n_calls", "n_answered", "n_invalid", "answers_turn", "sort_turn", "sort_depth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            for role, content, calls, answers in zip(*(batch.column(c).to_pylist() for c in ("role", "content", "calls", "answers")), strict=True):
                body: dict[str, object] = {"role": role, "content": content}
                if calls:
                    body["tool_calls"] = [{"id": c["id"], "name": c["name"], "arguments": None if c["arguments"] is None else json.loads(c["arguments"])} for c in calls]
                if answers is not None:
                    body["tool_call_id"] = answers
                out.append(canonical(body))
                counts.append(len(calls))
            kept = {"message": pa.array(out, pa.string()), "n_calls": pa.array(counts, pa.int32())}
            yield pa.RecordBatch.from_arrays([kept.get(n) if n in kept else batch.column(n) for n in names], names=names)

    schema = "conv_id bigint, turn bigint, role string, message string, n_calls int, n_answered int, n_invalid int, answers_turn bigint, sort_turn bigint, sort_depth int"
    return rows.select("conv_id", "turn", "role", "content", "calls", "answers", "n_answered", "n_invalid", "answers_turn", "sort_turn", "sort_depth").mapInArrow(run, schema)


#: Tools of the traces that tool_trace makes.
TRACE_TOOLS: dict[str, dict] = {
    "search": {"type": "object", "required": ["query", "chars"], "properties": {"query": {"type": "string", "maxLength": 40}, "chars": {"type": "integer", "minimum": 1, "maximum": 400}}, "additionalProperties": False},
    "rank": {"type": "object", "required": ["of", "limit"], "properties": {"of": {"type": "string"}, "after": {"type": "string"}, "limit": {"type": "integer", "minimum": 0, "maximum": 6}}, "additionalProperties": False},
}


def tool_trace(messages: DataFrame) -> DataFrame:
    """Conversations of plain text as traces of tool use, by rule and row by row.

    An assistant's message at turn t calls `rank` (identifier rt), which takes the results of the call that stands behind it, `search` (st), and of the rank call two turns
    before; if the number of the text's characters can be divided by 7, rank takes its own result instead, a circle. A user's message at turn t > 0 is the result of the rank
    call a turn before. Other rows stay as they are. Null texts count as empty in calls and results.
    """
    text, turn = F.coalesce("text", F.lit("")), F.col("turn").cast("string")
    ident = lambda letter, back=0: F.concat(F.lit(letter), (F.col("turn") - back).cast("string"))
    circle = F.char_length(text) % 7 == 0
    after = F.when(circle, F.concat(F.lit("$"), ident("r"))).when(F.col("turn") >= 2, F.concat(F.lit("$"), ident("r", 2)))
    call = lambda i, name, *arguments: F.concat(F.lit("<tool_call>"), F.to_json(F.struct(i.alias("id"), F.lit(name).alias("name"), F.struct(*arguments).alias("arguments"))), F.lit("</tool_call>"))
    rank = call(ident("r"), "rank", F.concat(F.lit("$"), ident("s")).alias("of"), after.alias("after"), F.col("turn").alias("limit"))
    search = call(ident("s"), "search", F.substring(text, 1, 40).alias("query"), F.char_length(text).alias("chars"))
    result = F.to_json(F.struct(ident("r", 1).alias("tool_call_id"), text.alias("content")))
    calls = (F.col("role") == "assistant") & turn.isNotNull()
    answers = (F.col("role") == "user") & (F.col("turn") > 0)
    return messages.select("conv_id", "turn", F.when(answers, "tool").otherwise(F.col("role")).alias("role"), F.when(calls, F.concat(text, rank, search)).when(answers, result).otherwise(F.col("text")).alias("text"))


ORACLE = r"""
WITH m AS (SELECT conv_id, turn, role, text, coalesce(text, '') AS t, length(coalesce(text, '')) AS chars FROM conversations),
a AS (SELECT DISTINCT ON (conv_id, turn) conv_id, turn, chars % 7 = 0 AS circle FROM m WHERE role = 'assistant'),
-- A rank call's chain: assistants' turns two apart.
i AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS chain FROM a),
-- A circle takes nothing from before it, but all that follow take its result.
d AS (SELECT conv_id, turn, CASE WHEN NOT bool_or(circle) OVER w THEN row_number() OVER w END AS depth
  FROM i WINDOW w AS (PARTITION BY conv_id, turn % 2, chain ORDER BY turn)),
e AS (SELECT conv_id, max(coalesce(depth, 0)) AS deepest FROM d GROUP BY conv_id),
r AS (SELECT DISTINCT conv_id, turn - 1 AS turn FROM m WHERE role = 'user' AND turn > 0)
SELECT m.conv_id, m.turn, CASE WHEN m.role = 'user' AND m.turn > 0 THEN 'tool' ELSE m.role END AS role,
  CASE WHEN m.role = 'assistant' THEN '{"content":' || to_json(regexp_replace(t, '^\s+|\s+$', '', 'g'))::VARCHAR || ',"role":"assistant","tool_calls":[{"arguments":{"chars":' || chars || ',"query":'
      || to_json(left(t, 40))::VARCHAR || '},"id":"s' || m.turn || '","name":"search"},{"arguments":{'
      || CASE WHEN chars % 7 = 0 THEN '"after":"$r' || m.turn || '",' WHEN m.turn >= 2 THEN '"after":"$r' || (m.turn - 2) || '",' ELSE '' END
      || '"limit":' || m.turn || ',"of":"$s' || m.turn || '"},"id":"r' || m.turn || '","name":"rank"}]}'
    WHEN m.role = 'user' AND m.turn > 0 THEN '{"content":' || to_json(t)::VARCHAR || ',"role":"tool","tool_call_id":"r' || (m.turn - 1) || '"}'
    ELSE '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(m.role)::VARCHAR, 'null') || '}' END AS message,
  CASE WHEN m.role = 'assistant' THEN 2 ELSE 0 END AS n_calls,
  CASE WHEN m.role = 'assistant' AND r.turn IS NOT NULL THEN 1 ELSE 0 END AS n_answered,
  CASE WHEN m.role = 'assistant' THEN (chars > 400 OR chars < 1)::INT + (own.depth IS NULL OR m.turn > 6)::INT ELSE 0 END AS n_invalid,
  CASE WHEN m.role = 'user' AND m.turn > 0 THEN before.turn END AS answers_turn,
  CASE WHEN m.role = 'user' AND m.turn > 0 THEN coalesce(before.turn, m.turn) ELSE m.turn END AS sort_turn,
  CASE WHEN m.role = 'user' AND m.turn > 0 AND before.turn IS NOT NULL THEN coalesce(before.depth, e.deepest + 1) + 1 ELSE 0 END::INT AS sort_depth
FROM m LEFT JOIN d AS own ON m.conv_id = own.conv_id AND m.turn = own.turn LEFT JOIN d AS before ON m.conv_id = before.conv_id AND m.turn = before.turn + 1
  LEFT JOIN e ON m.conv_id = e.conv_id LEFT JOIN r ON m.conv_id = r.conv_id AND m.turn = r.turn
"""
