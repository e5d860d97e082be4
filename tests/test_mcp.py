import json

import pytest

from loomstack import mcp


def talk(messages, search=lambda q, k: []):
    out = []
    mcp.serve([m if isinstance(m, str) else json.dumps(m) for m in messages], out.append, search)
    return [json.loads(x) for x in out]


def call(i, **arguments):
    return {"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": "search", "arguments": arguments}}


def test_conversation():
    hit = {"path": "a.py", "start_line": 1, "end_line": 2, "score": 0.5, "snippet": "é", "name": "hidden"}
    got = talk([{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, call(3, query="x", top_k=4), "", "not json", "[1]", {"id": 9, "method": "other"}], lambda q, k: [hit] if (q, k) == ("x", 4) else [])
    assert got[0]["result"]["serverInfo"]["name"] == "loomstack" and got[1]["result"]["tools"][0]["name"] == "search"
    assert json.loads(got[2]["result"]["content"][0]["text"]) == [{k: v for k, v in hit.items() if k != "name"}] and got[2]["result"]["isError"] is False
    assert [g["error"]["code"] for g in got[3:]] == [-32700, -32700, -32601]


@pytest.mark.parametrize("error,told", [(FileNotFoundError("/secret/path"), "the project is not indexed"), (ValueError("x"), "the query is empty or not valid"), (RuntimeError("abc"), "the index is older than the project"), (KeyError("k"), "the search failed")])
def test_errors_tell_only_their_kind(error, told):
    def fail(q, k):
        raise error

    r = talk([call(1, query="x")], fail)[0]["result"]
    assert r["isError"] and r["content"][0]["text"] == told
    assert talk([call(1, query=3)])[0]["result"]["content"][0]["text"] == "the query is empty or not valid"
