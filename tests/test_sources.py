import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomstack import cli
from loomstack.operators import snapshot
from loomstack.sources import files, logs, opencode
from loomstack.streaming import tail


def recs(agent, d):
    return logs.decode_line(agent, json.dumps(d))[0].records


def test_codex():
    call = recs("codex", {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "call_id": "c", "arguments": '{"command": ["x"], "cmd": "go test"}'}})[0]
    assert (call["role"], call["command"], call["call"]) == ("assistant", "go test", "c")
    out = recs("codex", {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": "exited with code: 2"}})[0]
    assert out["exit_code"] == 2 and out["kind"] == "command_output"
    assert logs.decode_line("codex", json.dumps({"type": "response_item", "payload": {"type": "reasoning", "text": "canary"}}))[0].reasoning == 1
    assert recs("codex", {"type": "event_msg", "payload": {"type": "task_complete"}})[0]["text"] == "complete"
    assert logs.decode_line("codex", "{malformed}")[1] and logs.decode_line("codex", " ")[0].noise == 1 and not logs.decode_line("codex", None)[1]


def test_claude_cursor_pi():
    c = recs("claude", {"type": "assistant", "sessionId": "s", "uuid": "u", "message": {"role": "assistant", "content": [
        {"type": "thinking", "thinking": "canary"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "ls"}}, {"type": "tool_result", "tool_use_id": "t", "is_error": True, "content": "bad"}]}})
    assert [(r["kind"], r["part_ordinal"]) for r in c] == [("message", 2), ("tool", 3), ("command_output", 4)] and c[2]["exit_code"] == 1 and c[1]["native_event_id"] == "t"
    assert recs("cursor", {"type": "turn_ended", "status": "failed"})[0]["kind"] == "status"
    p = recs("pi", {"type": "message", "id": "m", "parentId": "q", "message": {"role": "toolResult", "toolCallId": "k", "isError": True, "content": [{"type": "text", "text": "x"}]}})
    assert p[0]["call"] == "k" and p[0]["exit_code"] == 1 and p[0]["role"] == "tool"
    assert recs("pi", {"type": "message", "message": {"role": "moderator", "content": "x"}}) == []


def test_tool_inputs():
    patch = "*** Begin Patch\n*** Update File: a/b.go\n+x\n*** End Patch"
    assert logs.tool_call({"input": patch})["paths"] == ["a/b.go"]
    assert logs.tool_call({"z": "later", "a": "first"})["command"] == "first"
    assert logs.tool_call({"file_path": "x\\y.py", "content": "multi\nline"})["paths"] == ["x/y.py"]
    assert logs.tool_call('{"cmd": "ls -la"}')["command"] == "ls -la"
    assert logs.tool_call('const r = await tools.exec_command({cmd: "echo \\"hi\\""})')["command"] == 'echo "hi"'
    assert logs.tool_call({"n": 1.0, "a": [{"b": 2.5, "c": 3.0}]})["text"] == '{"a":[{"b":2.5,"c":3}],"n":1}' and logs.compact({"b": "<", "a": None, "t": True}) == '{"a":null,"b":"\\u003c","t":true}'


def test_records_frame(spark):
    line = json.dumps({"type": "message", "id": "m", "message": {"role": "user", "content": "hello"}})
    df = spark.createDataFrame([("pi/s", 1, 0, line), ("pi/s", 2, 9, "{bad"), ("pi/s", 3, 12, None)], "logical_id string, record_ordinal long, byte_offset long, line string")
    got = {r.record_ordinal: r for r in logs.records(df, "pi").collect()}
    assert got[1].text == "hello" and got[1].native_session_id == "s" and got[2].malformed and got[3].noise == 1 and got[3].role is None
    with pytest.raises(ValueError):
        logs.records(df, "unknown")


def test_headers(spark):
    lines = [{"type": "session_meta", "payload": {"id": "S", "cwd": "/w", "parent_id": "P"}}, {"cwd": "/late", "parent_id": "Q"}]
    df = spark.createDataFrame([("codex/x", i + 1, json.dumps(d)) for i, d in enumerate(lines)], "logical_id string, record_ordinal long, line string")
    r = logs.headers(df).first()
    assert (r.native_session_id, r.cwd, r.parent) == ("S", "/w", "P")


@pytest.mark.parametrize("rules,path,want", [
    ("docs/", "docs/a.md", True), ("docs/", "docs", False), ("*.log", "a/b.log", True), ("*.log\n!keep.log", "keep.log", False), ("/build", "x/build", False), ("/build", "build/x", True), ("a/*.c", "a/b/c.c", False), ("a/**", "a/b/c.c", True),
    ("**/t", "x/y/t", True), ("# no\n\n", "no", False)])
def test_ignore(spark, rules, path, want):
    r = files.IgnoreRules(rules)
    assert r.match(path) is want
    assert spark.createDataFrame([(path,)], "p string").select(r.ignored(F.col("p"))).first()[0] is want


def test_read_tree(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name, data in {"a.py": b"x = 1\n", "b.bin": b"\x00\x01", "node_modules/c.py": b"y", "empty.py": b"", "d.uid": b"z", "bad.txt": b"\xff\xfe\xfa"}.items():
        (tmp_path / name).write_bytes(data)
    assert [r.path for r in files.read_tree(spark, str(tmp_path)).collect()] == ["a.py"]


def test_opencode(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "o.db")
    db.executescript("create table session(id, project_id, parent_id, directory, title, time_created, time_updated); create table message(id, session_id, time_created, time_updated, data); create table part(id, message_id, session_id, time_created, time_updated, data)")
    db.execute("insert into session values ('s', 'p', null, '/w', 't', 1, 2)")
    db.execute("insert into message values ('m', 's', 1, 7, ?)", (json.dumps({"role": "user"}),))
    db.execute("insert into part values ('q', 'm', 's', 1, 5, ?)", (json.dumps({"type": "text", "text": "hi"}),))
    db.commit()
    opencode.RANGE = 2
    t = opencode.load(spark, str(tmp_path / "o.db"))
    assert opencode.sources(t).first().external_version == "7"
    p = opencode.parts(t).first()
    assert opencode.decode_part(p.role, p.data) == [{"role": "user", "kind": "message", "text": "hi"}] and opencode.content_version(t).count() == 1
    tool = opencode.decode_part("assistant", json.dumps({"type": "tool", "tool": "bash", "callID": "c", "state": {"status": "error", "error": "no", "input": {"command": "ls"}}}))
    assert [r["kind"] for r in tool] == ["tool", "command_output"] and tool[1]["exit_code"] == 1
    for k, data in enumerate(("no json", '{"type": "other"}', json.dumps({"type": "tool", "tool": "bash", "callID": "c", "state": {"status": "completed", "output": "exit code 3", "input": {"command": "ls"}}}), '{"type": "patch", "files": ["b", "a"], "hash": "h"}')):
        db.execute("insert into part values (?, 'm', 's', ?, 5, ?)", (f"x{k}", 2 + k, data))
    db.commit()
    r = opencode.records(opencode.load(spark, str(tmp_path / "o.db"))).orderBy("record_ordinal", "part_ordinal").collect()
    assert [(x.record_ordinal, x.part_ordinal, x.kind, x.command, x.exit_code, x.paths) for x in r] == [(1, 0, "message", "", None, []), (4, 0, "tool", "ls", None, []), (4, 1, "command_output", "", 3, []), (5, 0, "file_operation", "", None, ["a", "b"])]
    v = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "logical_id string, external_version string")
    assert {x.logical_id for x in opencode.changed(v, v.where("logical_id = 'a'").unionByName(spark.createDataFrame([("b", "1")], v.schema))).collect()} == {"b", "c"}
    db.execute("drop table part")
    db.commit()
    with pytest.raises(ValueError):
        opencode.load(spark, str(tmp_path / "o.db"))


def test_source_plan(spark):
    s = spark.createDataFrame([("a", 5, 1, "f"), ("b", 5, 1, "f"), ("c", 5, 1, "f"), ("gone", 5, 1, "f")], "logical_id string, size long, mtime_ns long, file_id string")
    d = spark.createDataFrame([("a", 5, 1, "f"), ("a", 5, 1, "f"), ("b", 9, 2, "f"), ("c", 9, 2, "g"), ("n", 1, 1, "h")], "logical_id string, size long, mtime_ns long, file_id string")
    assert {r.logical_id: r.plan for r in snapshot.source_plan(s, d).collect()} == {"a": "unchanged", "b": "extend", "c": "rebuild", "gone": "missing", "n": "new"}


def test_stream_tails_appends_and_rewrites(spark, tmp_path):
    logs_dir, sink, cp = tmp_path / "logs", f"{tmp_path}/sink", f"{tmp_path}/cp"
    logs_dir.mkdir()
    a = logs_dir / "a.jsonl"
    a.write_text('{"n":1}\n{"n":2}\n{"cut')
    go = lambda: tail.ingest(spark, f"{logs_dir}/*.jsonl", sink, cp)
    rows = lambda: sorted((r.path.rsplit("/", 1)[1], r.record_ordinal, r.line) for r in tail.lines(spark, sink).collect())
    go()
    assert rows() == [("a.jsonl", 1, '{"n":1}'), ("a.jsonl", 2, '{"n":2}')]
    with a.open("a") as f:
        f.write(' off"}\n{"n":3}\n')
    (logs_dir / "b.jsonl").write_text("x\n")
    go()
    assert rows() == [("a.jsonl", 1, '{"n":1}'), ("a.jsonl", 2, '{"n":2}'), ("a.jsonl", 3, '{"cut off"}'), ("a.jsonl", 4, '{"n":3}'), ("b.jsonl", 1, "x")]
    a.write_text("new\n")
    go()
    assert rows() == [("a.jsonl", 1, "new"), ("b.jsonl", 1, "x")]


def test_cli(spark, sf, capsys):
    assert any(r["name"] == "p1_found" for r in cli.run(["queries"]))
    assert cli.run(["--data", sf, "status"], spark)[0]["files"] > 0
    assert cli.parse_time("2026-01-01", True) - cli.parse_time("2026-01-01") == 86_399_999
    with pytest.raises(SystemExit):
        cli.parse_time("soon")
    assert len(cli.run(["--data", sf, "sessions", "--limit", "3"], spark)) <= 3
