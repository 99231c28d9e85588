"""Tool-call linking: calls and results hash-joined by identifier, ordered topologically, validated, written as canonical JSON.

A message that holds calls is a JSON object {"tool_calls": [{"id", "name", "arguments", "after"}]}; one that holds a
result is {"tool_call_id", "content"}. `after` names the call, or lists the calls, whose results a call builds on, so calls
form a graph; (depth, turn, pos) sorts every call behind all it builds on, depth being the longest path from a call
that builds on none. Chains, where each call builds on one, are followed by pointer doubling, in as many joins
as the logarithm of the longest; of the calls that build on several, the first BATCH of each conversation are settled in one
task, then the next. No whole conversation is gathered in one task.

Identifiers are those of a conversation. Of several calls with one identifier the least by (turn, pos, content) counts,
`copies` tells how many there were; of several results the least by (turn, content) among those at or after the call's
turn, else the least of all. Status: linked, no_result, no_call (a result without a call), cycle (calls that build on
each other, or on such calls; their depth is null) or early (all results are before the call). A call that builds on a call
that isn't there is as one that doesn't. Other messages, broken JSON and null texts make no rows. A null conversation is
one of its own, apart from one named "null"; a null turn sorts first.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import discard, materialize

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
#: For each tool the schema of its arguments, in the words of JSON Schema that `violations` knows.
SCHEMAS = {
    "search": {
        "type": "object", "required": ["query", "words"], "additionalProperties": False,
        "properties": {"query": {"type": "string"}, "words": {"type": "integer", "minimum": 0}, "exact": {"type": "boolean"}},
    },
    "summarise": {
        "type": "object", "required": ["text", "limit"], "additionalProperties": False,
        "properties": {"text": {"type": "string"}, "limit": {"type": "integer", "minimum": 0}},
    },
    "translate": {
        "type": "object", "required": ["text", "to"], "additionalProperties": False,
        "properties": {"text": {"type": "string"}, "to": {"type": "string", "enum": ["de", "en", "es", "fr"]}},
    },
}

#: Calls of one conversation that build on several, settled at once.
BATCH = 20_000

EVENTS = "conv string, turn long, pos int, kind string, id string, name string, after array<string>, body string, errors array<string>"


def canonical(value) -> str:
    """JSON with sorted keys and no spaces, characters unescaped."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _is(value, kind: str) -> bool:
    """Whether a value is of a kind. A number without a fraction is an integer, true and false are no numbers."""
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, KINDS[kind]) or kind == "integer" and isinstance(value, float) and value.is_integer()


def violations(value, schema: dict, at: str = "arguments") -> list[str]:
    """What a value lacks of a schema: type, enum, minimum, maximum, minLength, maxLength, minItems, maxItems, items, properties,
    required and additionalProperties. Names are those of the members, joined by points, with places of lists in brackets."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at} is no {' or '.join(kinds)}"]
    found = [f"{at} is none of the values"] * ("enum" in schema and value not in schema["enum"])
    size = value if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    length = len(value) if isinstance(value, (str, list)) else None
    kind = "Length" if isinstance(value, str) else "Items"
    for less, limit, own in (("too small", "minimum", size), ("too short", f"min{kind}", length)):
        found += [f"{at} is {less}"] * (own is not None and limit in schema and own < schema[limit])
    for more, limit, own in (("too large", "maximum", size), ("too long", f"max{kind}", length)):
        found += [f"{at} is {more}"] * (own is not None and limit in schema and own > schema[limit])
    if isinstance(value, list) and "items" in schema:
        found += [x for k, item in enumerate(value) for x in violations(item, schema["items"], f"{at}[{k}]")]
    if isinstance(value, dict):
        name = lambda key: key if at == "arguments" else f"{at}.{key}"
        known = schema.get("properties", {})
        for key in sorted({*known, *schema.get("required", [])}):
            if key in value:
                found += violations(value[key], known.get(key, {}), name(key))
            elif key in schema.get("required", []):
                found.append(f"{name(key)} is missing")
        if schema.get("additionalProperties") is False:
            found += [f"{name(key)} is unknown" for key in sorted(set(value) - set(known))]
    return found


def check_arguments(name: str | None, arguments, schemas: dict) -> list[str]:
    """What is wrong with the arguments of a call."""
    return violations(arguments, schemas[name]) if name in schemas else ["unknown tool"]


def _loads(text: str | None):
    try:
        return json.loads(text, parse_constant=lambda x: x) if text else None
    except (ValueError, RecursionError):
        return None


def read_events(conv: str | None, turn: int | None, text: str | None, schemas: dict) -> Iterator[tuple]:
    """The calls and the result of one message."""
    message = _loads(text)
    if not isinstance(message, dict):
        return
    calls = message.get("tool_calls")
    for pos, call in enumerate(calls if isinstance(calls, list) else []):
        if isinstance(call, dict) and isinstance(call.get("id"), str):
            name = call.get("name") if isinstance(call.get("name"), str) else None
            arguments = call.get("arguments")
            if isinstance(arguments, str):  # many writers put the arguments' JSON in a string
                parsed = _loads(arguments)
                arguments = arguments if parsed is None else parsed
            after = call.get("after")
            after = sorted({x for x in (after if isinstance(after, list) else [after]) if isinstance(x, str)})
            yield conv, turn, pos, "call", call["id"], name, after, canonical(arguments), check_arguments(name, arguments, schemas)
    if isinstance(message.get("tool_call_id"), str):
        yield conv, turn, 0, "result", message["tool_call_id"], None, [], canonical(message.get("content")), []


def _serialise(conv, turn, id_, name, after, call, result) -> str:
    out = {"id": id_, "name": name, "arguments": None if call is None else json.loads(call), "result": None if result is None else json.loads(result), "turn": turn, "conversation": conv}
    return canonical(out | ({"after": after[0] if len(after) == 1 else after} if after else {}))


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", schemas: dict | None = None) -> DataFrame:
    """conv, call_id, name, turn, pos, result_turn, depth, copies, valid, errors, status, json: a row for each identifier of a conversation."""
    schemas = SCHEMAS if schemas is None else schemas

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in EVENTS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]
        for batch in batches:
            found = [e for row in zip(*[c.to_pylist() for c in batch.columns], strict=True) for e in read_events(*row, schemas)]
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    # A key that isn't null: a null conversation is "", any other has a mark before its name.
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    slim = messages.select(key.alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(text).alias("text"))
    found = materialize(slim.mapInArrow(events, EVENTS))
    body = F.struct("turn", "pos", "body", "name", "after", "errors")
    calls = materialize(found.where("kind = 'call'").groupBy("conv", "id").agg(F.min(body).alias("c"), F.count(F.lit(1)).alias("copies")))
    answer = F.struct("turn", "body")
    since = F.col("since").isNull() | F.coalesce(F.col("turn") >= F.col("since"), F.lit(False))
    results = found.where("kind = 'result'").join(calls.select("conv", "id", F.col("c.turn").alias("since")), ["conv", "id"], "left")
    results = results.groupBy("conv", "id").agg(F.min(F.when(since, answer)).alias("late"), F.min(answer).alias("least"))
    results = results.select("conv", "id", F.coalesce("late", "least").alias("r"), F.col("late").isNull().alias("early"))
    linked = materialize(calls.join(results, ["conv", "id"], "full"))
    rows = linked.join(depths(linked.where("c is not null").select("conv", "id", "c.turn", "c.pos", "c.after")), ["conv", "id"], "left")
    status = (
        F.when(F.col("c").isNull(), "no_call")
        .when(F.col("depth").isNull(), "cycle")
        .when(F.col("r").isNull(), "no_result")
        .when(F.col("early"), "early")
        .otherwise("linked")
    )
    rows = rows.select(
        F.when(F.col("conv") != "", F.substr("conv", F.lit(2))).alias("conv"), F.col("id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.turn").alias("turn"), F.col("c.pos").alias("pos"),
        F.col("r.turn").alias("result_turn"), "depth", F.coalesce("copies", F.lit(0)).cast("long").alias("copies"),
        F.coalesce(F.size("c.errors") == 0, F.lit(False)).alias("valid"), F.coalesce("c.errors", F.array().cast("array<string>")).alias("errors"), status.alias("status"),
        F.coalesce("c.after", F.array().cast("array<string>")).alias("after"), F.col("c.body").alias("call"), F.col("r.body").alias("result"),
    )
    keep = [f for f in rows.schema.fields if f.name not in ("after", "call", "result")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.column(n).to_pylist() for n in ("conv", "turn", "call_id", "name", "after", "call", "result")]
            made = pa.array([_serialise(*row) for row in zip(*parts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], made], names=[*[f.name for f in keep], "json"])

    return rows.mapInArrow(write, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", json string")


def _settle(group: pa.Table) -> pa.Table:
    """The depths that follow from known ones, among some calls of one conversation given as edges (id, top, far, depth of the top)."""
    depth, open_, children = {}, Counter(), defaultdict(list)
    for id_, top, far, known in zip(*[group.column(c).to_pylist() for c in ("id", "top", "far", "depth")], strict=True):
        depth[id_] = max(depth.get(id_, 0), 0 if known is None else known + far)
        open_[id_] += known is None
        if known is None:
            children[top].append((id_, far))
    ready = [i for i in depth if not open_[i]]
    for top in ready:
        for id_, far in children.get(top, ()):
            depth[id_] = max(depth[id_], depth[top] + far)
            open_[id_] -= 1
            if not open_[id_]:
                ready.append(id_)
    return pa.table({"conv": pa.array([group.column("conv")[0].as_py()] * len(ready), pa.string()), "id": pa.array(ready, pa.string()), "depth": pa.array([depth[i] for i in ready], pa.int64())})


def depths(calls: DataFrame) -> DataFrame:
    """(conv, id, depth) of calls(conv, id, turn, pos, after): the longest path to a call that builds on none; null on and behind cycles."""
    there = calls.select("conv", F.col("id").alias("up"))
    edges = materialize(calls.select("conv", "id", F.explode("after").alias("up")).join(there, ["conv", "up"]).select("conv", "id", "up"))
    above = edges.groupBy("conv", "id").agg(F.count(F.lit(1)).alias("n"), F.min("up").alias("one"))
    # Pointers: a call that builds on one other points at it; any other is the end of its chain.
    start = calls.select("conv", "id").join(above, ["conv", "id"], "left")
    alone = F.coalesce("n", F.lit(0)) == 1
    up = start.select("conv", "id", F.coalesce("n", F.lit(0)).alias("n"), F.when(alone, F.col("one")).otherwise(F.col("id")).alias("top"), alone.cast("long").alias("far"), (~alone).alias("done"))
    up = materialize(up)
    open_, before = up.where("not done").count(), -1
    # A round doubles the distance that pointers reach. One that ends no chain ends none later either: what is left is cycles.
    while open_ and open_ != before:
        over = up.select(F.col("conv").alias("c2"), F.col("id").alias("i2"), F.col("n").alias("n2"), F.col("top").alias("top2"), F.col("far").alias("far2"), F.col("done").alias("done2"))
        step = up.join(over, (F.col("conv") == F.col("c2")) & (F.col("top") == F.col("i2")))
        last = up
        up = materialize(step.select("conv", "id", "n", F.col("top2").alias("top"), F.when(F.col("done"), F.col("far")).otherwise(F.col("far") + F.col("far2")).alias("far"), (F.col("done") | F.col("done2")).alias("done")))
        discard(last)
        before, open_ = open_, up.where("not done").count()
    ends = materialize(up.where("done and top = id and n = 0").select("conv", "id", F.lit(0).cast("long").alias("depth")))
    # The ends that build on several wait until all of these are known. One that builds on a cycle never is.
    several = up.where("n > 1").select("conv", "id").join(edges, ["conv", "id"])
    parents = up.select("conv", F.col("id").alias("up"), "top", (F.col("far") + 1).alias("far"), F.col("done").alias("sure"))
    waiting = several.join(parents, ["conv", "up"])
    never = waiting.where("not sure").select("conv", "id").distinct()
    waiting = waiting.join(never, ["conv", "id"], "left_anti").select("conv", "id", "top", "far")
    waiting = materialize(waiting.join(calls.select("conv", "id", "turn", "pos"), ["conv", "id"]))
    place = F.dense_rank().over(Window.partitionBy("conv").orderBy("turn", "pos", "id"))
    whole = False
    while waiting.limit(1).count():
        some = waiting if whole else waiting.withColumn("place", place).where(F.col("place") <= BATCH)
        known = some.join(ends.select("conv", F.col("id").alias("top"), "depth"), ["conv", "top"], "left")
        if whole:  # nothing at the front could be settled: one step anywhere, and if there is none, the rest builds on cycles
            now = known.groupBy("conv", "id").agg(F.bool_and(F.col("depth").isNotNull()).alias("all"), F.max(F.col("depth") + F.col("far")).alias("depth"))
            now = now.where("all").select("conv", "id", "depth")
        else:
            now = known.select("conv", "id", "top", "far", "depth").groupBy("conv").applyInArrow(_settle, "conv string, id string, depth long")
        now = materialize(now)
        if not now.limit(1).count():
            if whole:
                break
            whole = True
            continue
        last, ends, whole = (ends, waiting), materialize(ends.unionByName(now)), False
        waiting = materialize(waiting.join(now, ["conv", "id"], "left_anti"))
        discard(*last, now)
    tops = ends.select("conv", F.col("id").alias("top"), "depth")
    return up.where("done").join(tops, ["conv", "top"]).select("conv", "id", (F.col("depth") + F.col("far")).alias("depth"))


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """conversations with plain turns put as tool traffic: a user's turn calls a tool chosen by its text, building on
    the call two turns before, and at each eighth turn on the one four turns before as well; the assistant's turn after it
    is the result. A text of under three words names no number of words, so what needs one isn't valid. Texts that
    are such JSON already stay."""
    text = F.coalesce("text", F.lit(""))
    ident = lambda back: F.concat(F.lit("c"), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit("-"), (F.coalesce("turn", F.lit(0)) - back).cast("string"))
    tool = F.element_at(F.array(*[F.lit(x) for x in sorted(SCHEMAS)]), (F.pmod(F.crc32(text.cast("binary")), F.lit(len(SCHEMAS))) + 1).cast("int"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    words = F.when(words >= 3, words)
    arguments = (
        F.when(tool == "search", F.to_json(F.struct(words.alias("words"), text.alias("query"))))
        .when(tool == "summarise", F.to_json(F.struct(text.alias("text"), words.alias("limit"))))
        .otherwise(F.to_json(F.struct(text.alias("text"), F.lit("en").alias("to"))))
    )
    after = F.when((F.col("turn") >= 8) & (F.col("turn") % 8 == 0), F.array(ident(2), ident(4))).when(F.col("turn") >= 2, F.array(ident(2)))
    call = F.to_json(F.struct(F.array(F.struct(ident(0).alias("id"), tool.alias("name"), arguments.alias("arguments"), after.alias("after"))).alias("tool_calls")))
    result = F.to_json(F.struct(ident(1).alias("tool_call_id"), text.alias("content")))
    ready = F.get_json_object("text", "$.tool_calls").isNotNull() | F.get_json_object("text", "$.tool_call_id").isNotNull()
    payload = F.when(ready, F.col("text")).when(F.col("role") == "user", call).when(F.col("role") == "assistant", result)
    return conversations.select("conv_id", "turn", payload.alias("text"))
