import json
import os
import subprocess

import pytest

from loomstack import cli, project


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x.example", *args], check=True, capture_output=True)


def test_project_index_and_search(spark, tmp_path, capsys):
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "src" / "store.py").write_text("class SessionStore:\n    def load(self):\n        return 1\n")
    (root / "data.bin").write_bytes(b"\0\1\2")
    (root / "skip.env").write_text("SessionStore=1\n")
    (root / ".loomstackignore").write_text("*.env\n")
    git(root, "init", "-q")
    git(root, "remote", "add", "origin", "git@host.example:team/p.git")
    git(root, "add", "src"), git(root, "commit", "-qm", "one")
    at = ["--root", str(root)]
    stats = cli.run(["index", *at], spark)[0]
    assert (stats["added"], stats["full_rebuild"]) == (2, True) and "not ignored" in capsys.readouterr().err
    (root / ".gitignore").write_text(".loomstack/\n")
    assert [(r["path"], r["start_line"]) for r in cli.run(["search", *at, "SessionStore"], spark)] == [("src/store.py", 1)]
    git(root, "commit", "-q", "--allow-empty", "-m", "two")
    with pytest.raises(RuntimeError):
        cli.run(["search", *at, "SessionStore"], spark)
    assert cli.run(["status", *at], spark)[0]["stale"] is True
    stats = cli.run(["index", *at], spark)[0]
    assert (stats["added"], stats["unchanged"], stats["full_rebuild"]) == (1, 2, False) and cli.run(["status", *at], spark)[0]["stale"] is False
    facts = project.git_facts(str(root))
    assert facts["remote"] == "git@host.example:team/p.git" and len(facts["commit"]) == 40 and project.resolve(str(root / "src"))[0] == str(root)
    with project.writer_lock(str(root / ".loomstack")), pytest.raises(RuntimeError):
        cli.run(["index", *at], spark)
    assert "index --root" in open(cli.run(["hook", "install", *at], spark)[0]["hook"]).read()
    cli.run(["hook", "remove", *at], spark)
    assert not os.path.exists(root / ".git" / "hooks" / "post-commit")


def test_store_from_logs_to_documents(spark, tmp_path):
    log = tmp_path / "home" / ".pi" / "agent" / "sessions" / "z.jsonl"
    log.parent.mkdir(parents=True)
    message = lambda i, role, text, **k: {"type": "message", "id": f"m{i}", "timestamp": f"2026-03-03T00:00:0{i}Z", "message": {"role": role, "content": text, **k}}
    lines = [{"type": "session", "id": "p-1", "cwd": "/w"}, message(1, "user", "please build the rate limiter"), message(2, "assistant", "done"), message(3, "user", "actually change the scope")]
    log.write_text("".join(json.dumps(x) + "\n" for x in lines))
    s = ["--state", str(tmp_path / "state")]
    home = ["--home", str(tmp_path / "home"), "--agent", "pi"]
    assert cli.run([*s, "sync", *home, "--dry-run"], spark)[0]["events_added"] == 3 and cli.run([*s, "sync", *home], spark)[0]["events_added"] == 3
    assert [r["session_uid"] for r in cli.run([*s, "sessions"], spark)] == ["pi:p-1"] and len(cli.run([*s, "show", "p-1"], spark)) == 3
    assert [r["kind"] for r in cli.run([*s, "find", "rate", "limiter", "--session", "p-1"], spark)] == ["message"]
    episode = cli.run([*s, "episodes"], spark)[0]["episode_id"]
    assert episode.endswith(":user_correction") and cli.run([*s, "summary"], spark)[0]["episodes"] == 1
    cli.run([*s, "evidence", "pi:p-1", "--output", str(tmp_path / "e.json")], spark)
    cli.run([*s, "episode", episode, "--before", "1", "--output", str(tmp_path / "x.json")], spark)
    e, x = json.loads((tmp_path / "e.json").read_text()), json.loads((tmp_path / "x.json").read_text())
    assert e["schema_version"] == "session-evidence/v1" and [u["text"] for u in e["user_inputs"]] == ["please build the rate limiter", "actually change the scope"] and x["episode_id"] == episode and len(x["context_before"]) == 1
    assert cli.run([*s, "status"], spark) == [{"agent": "pi", "state": "ok", "count": 1}]
    with pytest.raises(SystemExit):
        cli.run([*s, "show", "nobody"], spark)


def test_tables_and_times(spark, sf):
    assert {"p1_found", "evidence_documents"} <= {r["name"] for r in cli.run(["queries"])}
    assert cli.run(["--data", sf, "status"], spark)[0]["files"] > 0 and len(cli.run(["--data", sf, "sessions", "--limit", "3"], spark)) == 3
    assert cli.parse_time("2026-01-02", True) - cli.parse_time("2026-01-02") == 86_399_999 and cli.one_line("a\n b" + "c" * 300).endswith("…")
    assert set(cli.run(["version"], spark)[0]) == {"schema", "tokenizer", "symbols", "spark", "python"}
    for bad in (["query", "nothing"], ["index"], ["sync"]):
        with pytest.raises(SystemExit):
            cli.run(bad, spark)
