"""Tool-call linking on a small fixture, and on random ones against plain Python."""

import json
import random
from collections import defaultdict

import pytest

from spindrift.llm import tool_calls


def call(id_, name="search", after=None, **arguments):
    return json.dumps({"tool_calls": [{"id": id_, "name": name, "arguments": arguments} | ({"after": after} if after else {})]})


def result(id_, content="ok"):
    return json.dumps({"tool_call_id": id_, "content": content})


def test_link(spark):
    ok = {"query": "q", "words": 1}
    rows = [
        ("a", 0, call("1", **ok)), ("a", 1, result("1", {"b": 1, "a": "é"})),
        ("a", 2, call("3", after="2", **ok)), ("a", 4, call("2", after="1", **ok)), ("a", 3, result("2")),
        ("a", 5, call("x", after="y", **ok)), ("a", 6, call("y", after="x", **ok)), ("a", 7, call("z", after="y", **ok)),
        ("a", 8, result("nobody")), ("a", 9, call("1", name="other")), ("a", 10, "no json {"), ("a", 11, None), ("a", None, "[]"),
        ("b", 0, call("1", words="x", more=1)), ("b", 1, result("1")), ("b", 1, result("1")), ("b", 2, call("s", "summarise", text="t", limit=True)),
        (None, 0, call("n", "translate", text="t", to="de", after="lost")),
        *[("deep", k, call(f"d{k}", after=f"d{k - 1}", **ok)) for k in range(40)],
    ]
    df = spark.createDataFrame([(c, t, x, "k") for c, t, x in rows], "conv_id string, turn int, text string, status string")
    got = {(r.conv, r.call_id): r for r in tool_calls.link(df).collect()}
    status = {k: r.status for k, r in got.items() if k[0] != "deep"}
    assert status == {
        ("a", "1"): "linked", ("a", "2"): "early", ("a", "3"): "no_result", ("a", "x"): "cycle", ("a", "y"): "cycle", ("a", "z"): "cycle",
        ("a", "nobody"): "no_call", ("b", "1"): "linked", ("b", "s"): "no_result", (None, "n"): "no_result",
    }
    assert [got["a", i].depth for i in "123xn"[:4]] == [0, 1, 2, None] and got[None, "n"].depth == 0
    assert [got["deep", f"d{k}"].depth for k in range(40)] == list(range(40))
    assert got["a", "1"].copies == 2 and got["a", "1"].valid and not got["b", "1"].valid
    assert got["b", "1"].errors == ["query is missing", "words is no integer", "more is unknown"]
    assert got["b", "s"].errors == ["limit is no integer"]
    assert got["a", "1"].json == '{"arguments":{"query":"q","words":1},"conversation":"a","id":"1","name":"search","result":{"a":"é","b":1},"turn":0}'
    assert tool_calls.link(df.limit(0)).count() == 0


def test_conversations_as_messages(spark):
    rows = [(1, 0, "user", "Hi there"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (2, 0, "system", "s"), (None, None, "user", "x"), (3, 0, "user", call("own", query="q", words=2)), (3, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.call_id: r for r in tool_calls.link(tool_calls.as_tool_messages(df)).collect()}
    assert set(got) == {"c1-0", "c1-2", "cnull-0", "own"}
    assert got["c1-0"].status == "linked" and got["c1-2"].depth == 1 and got["own"].valid
    # A text of under three words names no number of words, which two of the three tools need.
    assert [bool(got[i].errors) for i in ("c1-0", "c1-2", "cnull-0")] == [got[i].name != "translate" for i in ("c1-0", "c1-2", "cnull-0")]
    assert json.loads(got["c1-0"].json)["result"] == "yes"


def test_schemas():
    schema = {
        "type": "object", "required": ["a", "list"], "additionalProperties": False,
        "properties": {"a": {"type": ["integer", "null"], "minimum": 2, "maximum": 5}, "list": {"type": "array", "minItems": 1, "items": {"type": "object", "properties": {"s": {"type": "string", "maxLength": 3, "enum": ["x", "yy", "long"]}}}}},
    }
    wrong = lambda value: tool_calls.violations(value, schema)
    assert wrong({"a": None, "list": [{"s": "x"}, {}]}) == [] and wrong({"a": 3.0, "list": [{}]}) == []
    assert wrong([]) == ["arguments is no object"] and wrong({}) == ["a is missing", "list is missing"]
    assert wrong({"a": True, "list": []}) == ["a is no integer or null", "list is too short"]
    assert wrong({"a": 1, "list": [{"s": "long"}, {"s": "z"}, {"s": 1}, 2], "b": 0}) == ["a is too small", "list[0].s is too long", "list[1].s is none of the values", "list[2].s is no string", "list[3] is no object", "b is unknown"]
    assert wrong({"a": 5.5, "list": [{}]}) == ["a is no integer or null"] and wrong({"a": 6, "list": [{}]}) == ["a is too large"]


def brute(rows):
    """By plain walks: (conv, id) to (status, depth, copies, result content, valid)."""
    calls, results = defaultdict(list), defaultdict(list)
    low = lambda turn: -1 if turn is None else turn
    named = lambda c: sorted({a for a in (c["after"] if isinstance(c["after"], list) else [c["after"]]) if a is not None})
    for conv, turn, text in rows:
        try:
            m = json.loads(text or "")
        except ValueError:
            continue
        for pos, c in enumerate(m.get("tool_calls", [])):
            calls[conv, c["id"]].append((low(turn), pos, json.dumps(c["arguments"], sort_keys=True, separators=(",", ":")), named(c), c))
        if "tool_call_id" in m:
            results[conv, m["tool_call_id"]].append((low(turn), json.dumps(m["content"])))
    chosen = {k: min(v, key=lambda x: x[:4]) for k, v in calls.items()}

    def depth(conv, id_, seen):
        if id_ in seen:
            return None
        found = [depth(conv, a, {*seen, id_}) for a in chosen[conv, id_][3] if (conv, a) in chosen]
        return None if None in found else max(found, default=-1) + 1

    out = {}
    for key in {*calls, *results}:
        if key not in chosen:
            out[key] = ("no_call", None, 0, min(results[key])[1], False)
            continue
        turn, d = chosen[key][0], depth(*key, set())
        late = [r for r in results[key] if r[0] >= turn]
        r = min(late or results[key], default=None)
        status = "cycle" if d is None else "no_result" if r is None else "linked" if late else "early"
        out[key] = (status, d, len(calls[key]), r and r[1], isinstance(chosen[key][4]["arguments"].get("words"), int))
    return out


@pytest.mark.parametrize("batch", [20_000, 3])
def test_against_plain_walks(spark, monkeypatch, batch):
    monkeypatch.setattr(tool_calls, "BATCH", batch)
    rnd = random.Random(8)
    rows = []
    for conv in ["a", "null", None, "", "é", "long" * 50]:
        for k in range(60):
            after = rnd.choice([None, str(rnd.randrange(20)), [str(rnd.randrange(20)) for _ in range(rnd.randint(0, 3))]])
            if conv == "a" and after is not None:  # one without cycles, and deep
                after = [str(a) for a in range(max(0, k // 3 - 2), k // 3)]
            turn = rnd.choice([None, rnd.randrange(30)])
            if rnd.random() < 0.6:
                words = rnd.choice([3, "x" * rnd.choice([1, 5000])])
                rows.append((conv, turn, json.dumps({"tool_calls": [{"id": str(k // 3), "name": "search", "arguments": {"query": "q", "words": words}, "after": after}]})))
            else:
                rows.append((conv, turn, json.dumps({"tool_call_id": str(rnd.randrange(25)), "content": rnd.randrange(9)})))
    rows += rows[:5] + [("a", 1, ""), ("a", 1, "{")]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(c, t, x, 0) for c, t, x in rows], "conv_id string, turn int, text string, depth int")
    got = {(r.conv, r.call_id): (r.status, r.depth, r.copies, None if (c := json.loads(r.json)["result"]) is None else json.dumps(c), r.valid) for r in tool_calls.link(df).collect()}
    want = brute(rows)
    assert got == want
    assert {s for s, *_ in want.values()} == {"linked", "no_result", "no_call", "cycle", "early"} and max(d for _, d, *_ in want.values() if d is not None) > 5
