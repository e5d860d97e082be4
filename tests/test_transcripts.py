import pytest
from pyspark.sql import functions as F

from loomstack.operators import episodes as E
from loomstack.operators import normalize as N
from loomstack.operators import sessions as S

EV = "id long, session_id long, content_id long, source_id long, record_ordinal long, part_ordinal long, native_event_id string, parent_native_id string, ts long, role string, kind string, call_id string, exit_code int"


def ev(i, role="user", kind="message", session=1, content=None, ts=None, call="", code=None, native=""):
    return (i, session, content or i, 1, i, 0, native, "", (1_770_000_000_000 + i * 1000) if ts is None else ts, role, kind, call, code)


@pytest.mark.parametrize("text,want", [
    ('token = "abc"', "token = [REDACTED]"), ("API_KEY: xyz, next", "API_KEY: [REDACTED], next"), ("Authorization: Bearer abcdefgh12", "Authorization: Bearer [REDACTED]"), ("use sk-abcdefghijklmnop ok", "use [REDACTED] ok"),
    ("monkey business", "monkey business"), ("xsk-abcdefghijklmnop", "xsk-abcdefghijklmnop"), ("", "")])
def test_redact(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(N.redact(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("role,kind,tool,command,diff,text,code,want", [
    ("system", "status", "", "", "", "complete", None, "status"), ("assistant", "tool", "apply_patch", "", "d", "", None, "file_operation"), ("assistant", "tool", "shell", "go test ./...", "", "", None, "test"),
    ("assistant", "tool", "Bash", "ls", "", "", None, "command"), ("tool", "", "", "", "", "boom", 1, "error"), ("tool", "", "", "", "", "pytest failed", 2, "test_failure"), ("user", "message", "", "", "", "no,do it", None, "user_correction"),
    ("user", "message", "", "", "", "no, ", None, "message"), ("user", "message", "", "", "", "違います", None, "user_correction"), ("tool", "message", "", "", "", "fine", 0, "command_output"), ("assistant", None, None, None, None, None, None, "message")])
def test_kinds(spark, role, kind, tool, command, diff, text, code, want):
    df = spark.createDataFrame([(role, kind, tool, command, diff, text, code)], "role string, kind string, tool string, command string, diff string, text string, code int")
    assert df.select(N.classified(*(F.col(c) for c in df.columns))).first()[0] == want


def test_bounded_keeps_whole_characters(spark):
    text = "é" * 5000
    b = spark.createDataFrame([(text,), ("short",), (None,)], "t string").select(N.bounded(F.col("t"), F.lit(4096)).alias("b")).collect()
    assert b[0].b.truncated and len(b[0].b.text.encode()) <= 4096 and "�" not in b[0].b.text and N.MARKER in b[0].b.text and b[0].b.original_bytes == 10_000
    assert b[1].b.text == "short" and not b[1].b.truncated and b[1].b.sha256 == ""
    assert b[2].b.text is None and b[2].b.original_bytes == 0


def test_noise_and_observable(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "t string").select(f(F.col("t"))).first()[0]
    assert one("a" * 600, N.looks_like_base64) and not one("a" * 400, N.looks_like_base64) and not one("日" * 600, N.looks_like_base64) and one(None, N.looks_like_base64) is False
    assert one("# Files pasted by the user:\nx\n## My request: do it", N.observable) == "do it"
    assert one("<environment_context> ...", N.observable) == "" and one(" hi ", N.observable) == "hi"
    assert one('<subagent_notification>{"status":{"completed":" ok "}}</subagent_notification>', N.subagent_result) == "ok"
    assert one("exited with code: 17", N.exit_code) == 17 and one("exit status 1", N.exit_code) is None


def test_paths(spark):
    df = spark.createDataFrame([(["/w/a/b.py", "b\\c.py", "/w", " ", "/wx/d"], "/w")], "p array<string>, cwd string")
    assert df.select(N.normal_paths(F.col("p"), F.col("cwd"))).first()[0] == [".", "/wx/d", "a/b.py", "b/c.py"]


def test_duplicates_and_summaries(spark):
    rows = [ev(1, content=5, call="k"), ev(2, content=5, call="k"), ev(3, content=6, native="n"), ev(4, content=6, native="n", ts=0), ev(5, content=7, kind="status", role="system"), ev(6, content=7, kind="status", role="system")]
    d = S.duplicates(S.clean(spark.createDataFrame(rows, EV)))
    assert {r.id: r.duplicate_of for r in d.collect()} == {1: None, 2: 1, 3: 4, 4: None, 5: None, 6: None}
    sessions = spark.createDataFrame([(1,), (2,)], "id long")
    contents = spark.createDataFrame([(5, "x"), (6, None), (7, "Completed")], "id long, text string")
    got = {r.session_id: (r.event_count, r.status) for r in S.summaries(sessions, d, contents).collect()}
    assert got == {1: (6, "complete"), 2: (0, "unknown")}
    assert S.duplicates(S.clean(spark.createDataFrame([], EV))).count() == 0


def test_links(spark):
    rows = [ev(1, "assistant", "test", call="c"), ev(2, "tool", "command_output", call="c", code=1), ev(3, "tool", "command_output", call="c", code=0), ev(4, "assistant", "command"), ev(5, "tool", "error")]
    e = S.duplicates(S.clean(spark.createDataFrame(rows, EV)))
    assert {(r.id, r.linked_kind, r.kind) for r in S.call_links(e).collect()} == {(2, "test", "command_output"), (3, "command_output", "command_output")}
    late = [ev(3, "assistant", "command", call="k", ts=99), ev(5, "assistant", "test", call="k", ts=10), ev(9, "tool", "error", call="k", ts=1), ev(10, "assistant", "test", call="t"), ev(11, "tool", "error", call="t")]
    got = {(r.id, r.linked_kind, r.kind) for r in S.call_links(S.duplicates(spark.createDataFrame(late, EV))).collect()}
    assert got == {(9, "command", "error"), (11, "test", "test_failure")}
    assert [(r.output_id, r.exit_code) for r in S.last_outputs(e).collect()] == [(3, 0)]
    assert {(r.id, r.output_id) for r in S.next_outputs(e).collect()} == {(1, 2), (4, 5)}


def test_restatements_against_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(E, "BLOCK", 4)
    rng = random.Random(3)
    words = ["alpha", "beta", "q", "zzz", "日本", "10"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(60)] + [None, ""]
    rows = [(1 + i % 2, i, i, t) for i, t in enumerate(texts)]
    norm = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    want = {i for s, i, _, t in rows if norm(t) and any(s2 == s and j < i and norm(u) and (norm(u) == norm(t) or E.similarity(norm(u), norm(t)) >= 0.8) for s2, j, _, u in rows)}
    assert {r.id for r in E.restatements(spark.createDataFrame(rows, "session_id long, id long, pos long, text string")).collect()} == want


def test_upsert_rules(spark):
    cols = "seq long, session_uid string, title string, cwd string, repository string, task_lineage_id string, project_id string, started_at long, ended_at long"
    old = spark.createDataFrame([(1, "u", "", "/a", "", "l1", "p", 0, 5)], cols)
    new = spark.createDataFrame([(2, "u", "t", "/b", "r", "l2", "", 3, 4), (3, "v", None, None, None, None, None, None, None)], cols)
    got = {r.session_uid: r for r in S.upserted(old, new).collect()}
    u = got["u"]
    assert (u.title, u.cwd, u.repository, u.task_lineage_id, u.project_id, u.started_at, u.ended_at) == ("t", "/a", "r", "l2", "p", 3, 5)
    assert got["v"].title == "" and got["v"].started_at == 0


def test_episode_search_reaches_the_end_of_the_session(spark, sf, tmp_path):
    from loomstack.plans import transcripts

    event = lambda i, kind, session=1: {"id": i, "session_id": session, "content_id": i, "source_id": 1, "record_ordinal": i, "part_ordinal": 0, "ts": 1_770_000_000_000 + i * 1000, "role": "assistant", "kind": kind}
    events = [event(1, "error"), *[event(i, "message") for i in range(2, 60)], event(60, "error"), event(61, "message"), event(62, "error"), event(63, "message"), event(70, "error", 2)]
    rows = {"sessions": [{"id": i, "session_uid": f"u{i}", "agent": "pi", "status": ""} for i in (1, 2)], "session_events": events,
            "event_contents": [{"id": e["id"], "text": "the rate limiter" if e["id"] in (55, 61) else f"plain {e['id']}"} for e in events]}
    for name, values in rows.items():
        schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
        spark.createDataFrame([tuple(v.get(c) for c in schema.names) for v in values], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.episode_id: r.matched for r in transcripts.episode_search(spark, str(tmp_path)).collect()}
    assert got == {"u1:1:error": "55,61", "u1:60:error": "61"}
    anchored = transcripts._anchored(spark, str(tmp_path))
    assert {r.event_id: len(r.frame) for r in E.frames(anchored, 0, None).collect()} == {1: 63, 60: 4, 62: 2, 70: 1}
