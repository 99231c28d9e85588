"""Calls that name a list of calls they build on."""

import json

from spindrift.llm import tool_calls


def test_lists_are_followed(spark):
    call = lambda id_, after: json.dumps({"tool_calls": [{"id": id_, "name": "search", "arguments": {"query": "q", "words": 1}, "after": after}]})
    rows = [("a", k, call(i, after)) for k, (i, after) in enumerate([("1", None), ("2", "1"), ("3", ["2"]), ("4", ["1", "3"]), ("5", []), ("6", ["4", "5", "lost"]), ("7", ["6", "4"]), ("8", "7")])]
    got = {r.call_id: r for r in tool_calls.link(spark.createDataFrame(rows, "conv_id string, turn long, text string")).collect()}
    assert [got[i].depth for i in "12345678"] == [0, 1, 2, 3, 0, 4, 5, 6]
    assert all(r.valid for r in got.values()) and json.loads(got["4"].json)["after"] == ["1", "3"]
