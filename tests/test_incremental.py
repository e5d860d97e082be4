import hashlib
import random

import pytest

from loomstack.operators import incremental as I

LINES = "record_id long, logical_id string, record_ordinal long, byte_offset long, terminated boolean, line string"
SOURCES = "id long, logical_id string, cursor_offset long, cursor_ordinal long, content_hash string"


def log(name, texts, first_id, ended=True):
    rows, at = [], 0
    for k, t in enumerate(texts, 1):
        rows.append((first_id + k, name, k, at, ended or k < len(texts), t))
        at += len((t or "").encode()) + 1
    return rows


def sha(*texts):
    return hashlib.sha256("".join(t + "\n" for t in texts).encode()).hexdigest()


def planned(spark, lines, offsets):
    df = spark.createDataFrame(lines, LINES)
    plan = I.planned(df, I.log_states(df, I.source_offsets(spark.createDataFrame(offsets, SOURCES))))
    return {(r.record_id, r.mode) for r in plan.collect()}


def test_append_rewrite_new_and_gone(spark):
    lines = log("a", ["one", "two", "zwölf"], 0) + log("b", ["x", "changed"], 10) + log("c", ["new"], 20) + log("d", ["read", "cut off"], 30, ended=False)
    offsets = [(1, "a", 8, 2, sha("one", "two")), (2, "b", 4, 2, sha("x", "y")), (3, "gone", 9, 1, sha("zz")), (4, "d", 5, 1, sha("read"))]
    assert planned(spark, lines, offsets) == {(3, "append"), (11, "rebuild"), (12, "rebuild"), (21, "rebuild")}


def test_cursor_inside_a_line_is_honoured(spark):
    half = hashlib.sha256(b"one\ntw").hexdigest()
    assert planned(spark, log("a", ["one", "two"], 0), [(1, "a", 6, 1, half)]) == {(2, "append")}


def test_nulls_empty_tables_repeats_and_extra_columns(spark):
    lines = log("a", [None, ""], 0)
    assert planned(spark, lines, []) == {(1, "rebuild"), (2, "rebuild")}
    assert planned(spark, [], [(1, "a", 3, 1, "x")]) == set()
    assert planned(spark, lines, [(1, "a", None, None, None)]) == {(1, "rebuild"), (2, "rebuild")}
    assert planned(spark, lines, [(1, "a", 0, 0, hashlib.sha256(b"").hexdigest())]) == {(1, "append"), (2, "append")}
    assert planned(spark, lines, [(1, "a", 1, 1, sha("")), (1, "a", 1, 1, sha(""))]) == {(2, "append")}
    df = spark.createDataFrame(lines, LINES).selectExpr("*", "1 as cursor_offset", "2 as same", "3 as states")
    assert I.new_rows(df, spark.createDataFrame([], SOURCES)).count() == 2
    assert planned(spark, lines + lines, []) == {(1, "rebuild"), (2, "rebuild")}
    assert planned(spark, [(1, None, 1, 0, True, "x"), (2, "a", None, 0, True, "y")], []) == {(2, "rebuild")}


def test_long_log_streams(spark):
    texts = [f"line {i} " + "x" * 50 for i in range(30_000)]
    n = 25_000
    assert len(planned(spark, log("a", texts, 0), [(1, "a", len(("".join(t + "\n" for t in texts[:n])).encode()), n, sha(*texts[:n]))])) == 5_000


def contents(sync):
    return sorted((r.logical_id, r.record_ordinal, r.line) for r in sync.sink().collect())


def test_run_survives_failures_without_skip_or_repeat(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    first = spark.createDataFrame(log("a", ["1", "2"], 0) + log("b", ["x"], 10), LINES)
    sync = I.IncrementalSync(spark, state)
    with pytest.raises(RuntimeError):
        sync.run(first, fail_after="plan")
    grown = spark.createDataFrame(log("a", ["1", "2", "3"], 0) + log("b", ["x"], 10), LINES)
    with pytest.raises(RuntimeError):
        I.IncrementalSync(spark, state).run(grown, fail_after="sink")  # replays the first plan: 3 is not in it
    assert I.IncrementalSync(spark, state).run(grown) == 1
    assert contents(sync) == [("a", 1, "1"), ("a", 2, "2"), ("b", 1, "x")]
    assert sync.run(grown) == 2
    assert sync.batch(2).count() == 1
    assert contents(sync) == [("a", 1, "1"), ("a", 2, "2"), ("a", 3, "3"), ("b", 1, "x")]
    assert sync.batch(sync.run(grown)).count() == 0


@pytest.mark.parametrize("after,stop,new_ids", [
    (["NEW0", "NEW1", "NEW2"], "plan", False), (["NEW0", "NEW1", "NEW2"], "sink", True), (["x0"], "plan", True), (["x0"], "sink", False), (["x0", "x1", "x2", "x3"], "sink", True), ([], "plan", False)])
def test_log_changed_between_failure_and_replay(spark, tmp_path, after, stop, new_ids):
    """The replay brings what was planned; the run after it sees the change, whatever it is."""
    sync = I.IncrementalSync(spark, f"file://{tmp_path}/state")
    sync.run(spark.createDataFrame(log("a", ["x0"], 0) + log("b", ["k"], 90), LINES))
    planned_rows = spark.createDataFrame(log("a", ["x0", "x1"], 0) + log("b", ["k"], 90), LINES)
    with pytest.raises(RuntimeError):
        sync.run(planned_rows, fail_after=stop)
    changed = spark.createDataFrame(log("a", after, 50 if new_ids else 0) + log("b", ["k"], 90), LINES)
    sync.run(changed)
    assert contents(sync) == [("a", 1, "x0"), ("a", 2, "x1"), ("b", 1, "k")]
    sync.run(changed)
    want = [("a", k, t) for k, t in enumerate(after, 1)] if after else [("a", 1, "x0"), ("a", 2, "x1")]  # a log that is gone keeps its rows
    assert contents(sync) == [*want, ("b", 1, "k")]


def test_any_change_between_any_two_steps(spark, tmp_path):
    """Random appends, rewrites, truncations and failures; after an undisturbed run the sink equals a fresh read of the logs."""
    rng = random.Random(5)
    logs, ids = {"a": ["a1"], "b": ["b1", "b2"], "c": []}, [0]

    def table():
        rows = []
        for name, texts in logs.items():
            rows += log(name, texts, ids[0], ended=rng.random() < 0.7)
            ids[0] += rng.choice([0, 100])
        return rows

    sync = I.IncrementalSync(spark, f"file://{tmp_path}/state")
    for step in range(7):
        for name in logs:
            move = rng.choice(["none", "append", "append", "rewrite", "cut"])
            if move == "append":
                logs[name] = logs[name] + [f"{name}{step}", ""]
            elif move == "rewrite":
                logs[name] = [f"r{step}"] + logs[name][1:]
            elif move == "cut":
                logs[name] = logs[name][:1] or ["q"]
        rows = table()
        df = spark.createDataFrame(rows, LINES)
        stop = rng.choice([None, "plan", "sink"])
        try:
            sync.run(df, fail_after=stop)
        except RuntimeError:
            continue
        sync.run(df)  # the run above may have been a replay
        assert contents(sync) == sorted((r[1], r[2], r[5]) for r in rows if r[4]), step
