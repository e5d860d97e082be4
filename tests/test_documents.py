import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomstack.operators import documents as D
from loomstack.operators import episodes as E
from loomstack.operators import sessions as S

EV = "id long, session_id long, content_id long, source_id long, record_ordinal long, part_ordinal long, byte_offset long, source_line long, native_event_id string, parent_native_id string, ts long, role string, kind string, call_id string, exit_code int, source_hash string"
T0 = 1_770_000_000_000


def ev(i, role="user", kind="message", call="", code=None, session=1, content=None, source=1):
    return (i, session, content or i, source, i, 0, 10 * i, i, f"n{i}", "", T0 + i * 1000, role, kind, call, code, "h" * 8)


def full(spark, events, texts, commands=None, diffs=None, files=None):
    commands, diffs = commands or {}, diffs or {}
    e = S.duplicates(S.clean(spark.createDataFrame(events, EV)))
    c = spark.createDataFrame([(i, f"c{i}", texts.get(i), commands.get(i), diffs.get(i)) for i in {x[2] for x in events}], "id long, content_hash string, text string, command string, diff string")
    s = spark.createDataFrame([(1, "/log", "hash", "ok"), (2, "", "", "missing")], "id long, path string, content_hash string, state string")
    return D.full_events(e, c, s, files), c


SESSIONS = "id long, session_uid string, native_id string, agent string, parent_session_id string, role_in_tree string, repository string, started_at long, ended_at long, status string, event_count long, task_lineage_id string, project_id string, workspace_id string"


def sessions(spark, status="active"):
    return spark.createDataFrame([(1, "pi:a:b", "a:b", "pi", "", "root", "/r", T0, 0, status, 9, "l", "p", "w"), (2, "pi:c", "c", "pi", "", "root", "", 0, 0, "", 0, "", "", "")], SESSIONS)


def test_millis(spark):
    got = spark.createDataFrame([(0,), (-1,), (None,), (T0,), (T0 + 120,), (T0 + 5,)], "t long").select(D.format_millis(F.col("t"))).collect()
    assert [r[0] for r in got] == ["", "", "", "2026-02-02T02:40:00Z", "2026-02-02T02:40:00.12Z", "2026-02-02T02:40:00.005Z"]


def test_evidence_document(spark):
    events = [ev(1), ev(2, "assistant", "test", "k"), ev(3, "tool", "test_failure", "k", 1), ev(4, "user", "user_correction"), ev(5, "assistant", "file_operation"), ev(6, "assistant", "file_operation"), ev(7, "assistant"), ev(8, "assistant", "command"), ev(9, content=1)]
    events[8] = (*events[8][:8], "n1", *events[8][9:])  # the same occurrence again
    f, _ = full(spark, events, {1: "do <it>", 3: "boom", 4: "no, that", 7: "done"}, {2: "go test", 8: "ls"}, {5: "+++ b/x.go\n+a", 6: "+++ b/x.go\n+++ b/y.go\n"})
    docs = D.checked_size(D.session_evidence(f, sessions(spark))).collect()
    assert len(docs) == 1
    d = docs[0].asDict(recursive=True)
    assert (d["schema_version"], d["session"]["id"], d["session"]["ended_at"], d["omitted"]["duplicate_events"]) == ("session-evidence/v1", "pi:a:b", "", 1)
    assert [(u["kind"], u["text"]) for u in d["user_inputs"]] == [("request", "do <it>"), ("correction", "no, that")] and d["task"]["text"] == "do <it>" and d["final_response"]["text"] == "done"
    assert [(c["command"]["text"], c["outcome"], c["exit_code"], (c["output"] or {}).get("text")) for c in d["commands"]] == [("go test", "failure", 1, "boom"), ("ls", "unknown", None, None)]
    assert [x["path"] for x in d["files_changed"]] == ["x.go", "y.go"] and [x["kind"] for x in d["errors"]] == ["test_failure"]
    joined = "+++ b/x.go\n+a\n+++ b/x.go\n+++ b/y.go\n"
    assert (d["diff"]["text"], d["diff"]["sha256"], len(d["diff"]["sources"])) == (joined, hashlib.sha256(joined.encode()).hexdigest(), 2)
    assert d["user_inputs"][0]["source"] == {"path": "/log", "hash": "h" * 8, "line": 1, "byte_offset": 10, "state": "ok"}
    assert D.session_evidence(f.where("false"), sessions(spark)).count() == 0


def test_sections_keep_to_their_budgets(spark):
    n = 400
    f, _ = full(spark, [ev(i) for i in range(1, n)] + [ev(i, "assistant", "file_operation") for i in range(n, n + 50)], {i: f"{i} " + "é" * 600 for i in range(1, n)}, None, {i: f"+++ b/f{i}\n" + "日" * 3000 for i in range(n, n + 50)})
    d = D.checked_size(D.session_evidence(f, sessions(spark))).first()
    kept = [int(u.text.split()[0]) for u in d.user_inputs]
    assert kept == sorted(kept) and kept[0] == 1 and kept[-1] == n - 1 and len(kept) + d.omitted.user_inputs == n - 1
    size = sum(len(json.dumps(u.asDict(recursive=True), ensure_ascii=False, separators=(",", ":")).encode()) for u in d.user_inputs)
    assert 130 << 10 < size < 170 << 10
    assert d.diff.truncated and len(d.diff.text.encode()) <= 64 << 10 and "�" not in d.diff.text and d.omitted.diff_sources == 18 and len(d.diff.sources) == 32
    with pytest.raises(Exception, match="exceeds the limit"):
        D.checked_size(D.session_evidence(f, sessions(spark)), 1000).collect()


def anchored(spark, f, contents):
    return f.where("duplicate_of is null").join(E.anchors(S.duplicates(f.select(*[c.split()[0] for c in EV.split(", ")])), contents.select("id", "text")).select("id", "anchor"), "id")


def test_episode_document(spark):
    events = [ev(1), ev(2, "assistant", "test", "k"), ev(3, "tool", "test_failure", "k", 1), ev(4), ev(5, "assistant", "command", "c"), ev(6, "tool", "command_output", "c", 0), ev(7, "assistant"), ev(8, "system", "status")]
    f, c = full(spark, events, {1: "please", 3: "boom", 4: "only this scope", 7: "report", 8: "complete"}, {2: "go test", 5: "ls"})
    a = anchored(spark, f, c)
    got = {r.episode_id: r for r in D.episode_documents(a, sessions(spark), before=1).collect()}
    assert set(got) == {"pi:a:b:3:test_failure", "pi:a:b:4:scope_revision"}
    e = got["pi:a:b:3:test_failure"]
    assert [x.event_id for x in e.context_before] == [2] and [x.event_id for x in e.corrections] == [3, 4] and [x.event_id for x in e.actions_after] == [4, 5, 6, 7, 8] and e.source_event_ids == [2, 3, 4, 5, 6, 7, 8]
    assert [(o.event_id, o.outcome) for o in e.outcomes] == [(2, "failure"), (3, "failure"), (5, "success"), (6, "success"), (8, "success")] and e.final_report.event_id == 7 and e.task_status == "complete"
    one = D.episode_by_id(a, sessions(spark), "pi:a:b:4:scope_revision", after=2).collect()
    assert len(one) == 1 and one[0].source_event_ids == [4, 5, 6] and one[0].context_before == [] and one[0].task_status == "unknown"
    for bad in ("x", "a:0:error", "a:b:error"):
        with pytest.raises(ValueError, match="invalid"):
            D.split_episode_id(bad)
    for bad in ("pi:a:b:4:error", "pi:a:b:1:error", "pi:zz:4:scope_revision"):
        with pytest.raises(ValueError, match="not"):
            D.episode_by_id(a, sessions(spark), bad)
    with pytest.raises(ValueError):
        D.episode_documents(a, sessions(spark), before=-1)
    tight = {r.episode_id: r for r in D.episode_documents(a, sessions(spark), before=2, byte_budget=700, token_budget=1000).collect()}["pi:a:b:3:test_failure"]
    assert tight.source_event_ids[:1] == [1] and 3 in tight.source_event_ids and tight.omitted.events == 8 - len(tight.source_event_ids) > 0 and tight.omitted.tokens * 4 >= tight.omitted.bytes


def test_episode_needs_whole_sources(spark):
    f, c = full(spark, [ev(1, "tool", "error", source=2)], {1: "x"})
    f = f.withColumn("source", F.col("source").withField("hash", F.lit("")))
    a = anchored(spark, f, c)
    with pytest.raises(Exception, match="without a whole source"):
        D.episode_documents(a, sessions(spark)).collect()
    assert D.episode_documents(a, sessions(spark), strict=False).count() == 1


@pytest.mark.parametrize("sizes,anchor,budget,want", [([5, 5, 5, 5], 4, 10, [1, 2, 4]), ([50, 5], 2, 10, [1, 2]), ([1, 2], 1, 0, [1, 2]), ([5, 9, 5], 1, 10, [1, 3])])
def test_greedy_budget_of_frames(spark, sizes, anchor, budget, want):
    rows = spark.createDataFrame([(7, anchor, 100 + k, k, n) for k, n in enumerate(sizes, 1)], "anchor_id long, anchor_n long, id long, n long, size long")
    assert sorted(r.n for r in D.within_frame_budget(rows, budget).collect() if r.kept) == want


def test_files_and_filters(spark):
    f, c = full(spark, [ev(1, "assistant", "file_operation"), ev(2)], {}, None, {1: "*** Begin Patch\n*** Update File:  a b.py \n*** Add File: c.py\n+++ b/a b.py"})
    files = D.content_files(c)
    assert {tuple(r) for r in files.collect()} == {(1, "a b.py"), (1, "c.py")} and D.joined_paths(files, "|").first().paths == "a b.py|c.py"
    assert [r.id for r in D.touching(f, files, "c.py").collect()] == [1] and D.touching(f, files, "zz").count() == 0
    index = S.event_index(c.withColumn("text", F.lit("rate limiter")))
    hits = S.search_events(index, f, sessions(spark), "limiter", session="a:b", workspace="w", repository="/r", files=files, file="c.py")
    assert [r.event_id for r in hits.collect()] == [1] and S.search_events(index, f, sessions(spark), "limiter", session="other").count() == 0
    assert D.search_summary(S.search_events(index, f, sessions(spark), "limiter", whole=True)).first().raw_events == 2
