import hashlib

import pytest
from pyspark.sql import functions as F

from loomstack.functions import text as T
from loomstack.operators import bm25, index, windows

#: A small project: (path, content).
PROJECT = {
    "app/store.gd": "extends Node\nclass_name SessionStore\n\nfunc load_session(key):\n\tpass\n", "app/ui.gd": "extends Control\n# the SessionStore is used here\nvar x = SessionStore.new()\n",
    "docs/SessionStore.md": "# SessionStore\nSessionStore SessionStore SessionStore text.\n", "auth/session.go": "package auth\n\nfunc getUserProfile(id int) string {\n\treturn \"\"\n}\n",
    "docs/token.md": "トークンの有効期限について\n", "docs/notes.md": "same-moment iteration processed events in the resolver\n", "docs/budget.md": "event turn budget is tracked per window\n", "core/input.gd": "class_name InputManager\n# InputManager.handle takes each event\nfunc handle(event):\n\tpass\n",
    "core/call.gd": "func go():\n\tInputManager.handle(1)\n\tInputManager.handle(2)\n", "lib/stats.py": "def load_user_stats(x):\n    return x\n\n\ndef other():\n    pass\n"}


def table(spark, files):
    rows = [(p, 1, len(t), t, hashlib.sha256(t.encode()).hexdigest()) for p, t in files.items()]
    return spark.createDataFrame(rows, "path string, mtime long, size long, content string, content_hash string")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    at = index.CodeIndex(spark, f"file://{tmp_path_factory.mktemp('ix')}/index", 3)
    assert at.build(table(spark, PROJECT), facts={"commit": "c1"})["added"] == len(PROJECT)
    return at


@pytest.mark.parametrize("query,want,top", [
    ("SessionStore", "app/store.gd", 1), ("getUserProfile", "auth/session.go", 5), ("有効期限", "docs/token.md", 5), ("same-moment iteration processed event turn budget", "docs/notes.md", 5), ("InputManager.handle", "core/input.gd", 5), ("load_user_stats", "lib/stats.py", 5), ("func handle", "core/input.gd", 1)])
def test_relevance(built, query, want, top):
    assert want in [r.path for r in built.search(query, 10).collect()][:top]


def test_index_ranks_like_a_scan(spark, built):
    files = table(spark, PROJECT)
    from loomstack.operators import chunking

    cut = chunking.chunks(files, "path", "content").withColumnRenamed("body", "raw_body")
    scan = bm25.chunk_index(cut)
    for q in ("load_user_stats", "SessionStore text", "absent words"):
        for mode in ("and", "or"):
            want = {(r.path, r.start_line): round(r.score, 9) for r in bm25.scored(scan, T.query_phrases(q), bm25.CHUNK_WEIGHTS, mode).collect()}
            rows = built._hits("chunk", built.scored("chunk", T.query_phrases(q), mode), "raw_body").collect()
            assert {(r.path, r.start_line): round(r.score, 9) for r in rows} == want, (q, mode)


def test_search_reads_only_the_buckets_of_its_terms(built):
    plan = built.postings("chunk", ["session"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,session)" in plan


def test_refresh_equals_a_rebuild(spark, tmp_path, monkeypatch):
    at = index.CodeIndex(spark, f"file://{tmp_path}/a", 2)
    now = dict(PROJECT)
    at.build(table(spark, now))
    monkeypatch.setattr(index, "MAX_SEGMENTS", 2)
    steps = [({"lib/stats.py": "def load_user_stats(x, y):\n    return y\n"}, []), ({"docs/token.md": "", "new/file.py": "class Fresh:\n    pass\n" + "event budget\n" * 200}, ["docs/budget.md"]), ({}, ["app/ui.gd"])]
    for changed, gone in steps:
        was = dict(now)
        now = {k: v for k, v in (now | changed).items() if k not in gone}
        s = at.build(table(spark, now))
        assert (s["added"], s["updated"], s["removed"], s["full_rebuild"]) == (len([k for k in changed if k not in was]), len([k for k in changed if k in was]), len(gone), False)
        new = index.CodeIndex(spark, f"file://{tmp_path}/b", 2)
        t = new.build(table(spark, now), force=True)
        assert [s[k] for k in ("files", "chunks", "symbols")] == [t[k] for k in ("files", "chunks", "symbols")]
        for q in ("SessionStore", "event budget"):
            assert at.search(q, 20).collect() == new.search(q, 20).collect()
    assert len(at.segments()) <= 2
    assert at.build(table(spark, now), languages=frozenset(["go"]))["full_rebuild"] and at.build(table(spark, {}))["files"] == 0 and at.search("event").count() == 0


def test_a_build_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    at = index.CodeIndex(spark, f"file://{tmp_path}/a", 2)
    with pytest.raises(FileNotFoundError):
        at.search("x y")
    at.build(table(spark, PROJECT))
    before = at.search("SessionStore").collect()

    def die(*a, **k):
        raise RuntimeError("lost")

    monkeypatch.setattr(index.CodeIndex, "_commit", die)
    with pytest.raises(RuntimeError):
        at.build(table(spark, {"other.md": "SessionStore"}))
    monkeypatch.undo()
    assert at.search("SessionStore").collect() == before
    at.build(table(spark, {"other.md": "SessionStore"}), facts={"commit": "abc"})
    assert [r.path for r in at.search("SessionStore").collect()] == ["other.md"]
    at.ensure_fresh("abc"), at.ensure_fresh("")
    with pytest.raises(RuntimeError):
        at.ensure_fresh("def")
    with pytest.raises(ValueError):
        at.search("  ")


def test_windows_become_files_again(spark):
    text = "\n".join(f"l{i}" for i in range(1, 31)) + "\n"
    lines = text.split("\n")
    cut = [(1, "a.py", a, b, "\n".join(lines[a - 1:b]) + ("\n" if b == 30 else "")) for a, b in ((1, 12), (10, 20), (10, 20), (21, 30))]
    rows = [*cut, (2, "b", 3, 4, "x\r\ny"), (3, "c", 1, 1, None), (None, "d", 1, 1, "z"), (4, "e", None, 2, "q")]
    got = {r.file_id: r.content for r in windows.reassembled(spark.createDataFrame(rows, "file_id long, path string, start_line int, end_line int, raw_body string").withColumn("content", F.lit(1))).collect()}
    assert got == {1: text.rstrip("\n"), 2: "\n\nx\ny", 3: ""}
