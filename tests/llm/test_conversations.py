import random

from pyspark.sql import functions as F

from loomstack.llm import conversations as C

EV = "id long, session_id long, content_id long, record_ordinal long, part_ordinal long, native_event_id string, role string, kind string"


def brute(sessions, events, contents):
    """Reasons by walking each session."""
    text = {i: t for i, t in contents}
    first = {}
    for e in sorted(events):
        key = (e[1], e[4], (e[5] or "").strip().lower())
        if key[2]:
            first.setdefault(key, e[0])
    kept = [e for e in events if not (e[5] or "").strip() or first[(e[1], e[4], e[5].strip().lower())] == e[0]]
    out = {}
    for s in {*sessions, *(e[1] for e in events)}:
        msgs = {}
        for e in sorted((e for e in kept if e[1] == s and e[7] in C.MESSAGE_KINDS and (text.get(e[2]) or "").strip()), key=lambda e: (e[3], e[4], e[0])):
            r = (e[6] or "").strip().lower()
            msgs.setdefault(e[3], []).append("tool" if r in ("toolresult", "tool_result") else r)
        roles = [msgs[k] for k in sorted(msgs)]
        talk = [r[0] for r in roles if r[0] in ("user", "assistant")]
        if not roles:
            out[s] = "empty"
        elif any(x not in C.ROLES for r in roles for x in r) or talk and talk[0] != "user":
            out[s] = "broken"
        elif any(a == "user" and b != "assistant" for a, b in zip(talk, talk[1:] + ["end"])):
            out[s] = "no_reply"
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 3)
    rng = random.Random(11)
    events, contents, i = [], [], 0
    for s in range(1, 120):
        for o in range(rng.randint(0, 9)):
            i += 1
            contents.append((i, rng.choice(["hi", "ok", "yes", " ", None, "x" * 20_000 if i == 50 else "a"])))
            role = rng.choice(["user", "assistant", "User ", "ASSISTANT", "tool", "toolResult", "system"] + (["moderator", None, ""] if s % 5 == 0 else []))
            events.append((i, s, i, o, rng.choice([0, 0, 1]), rng.choice([None, "", f"n{o}", f" N{o} "]), role, rng.choice(["message", "message", "user_correction", "command"])))
    events.append(events[0])  # a repeated row
    sessions = list(range(1, 125))
    e = spark.createDataFrame(events, EV).selectExpr("*", "1 as role_in_tree", "2 as reason", "3 as block")
    got = C.verdicts(spark.createDataFrame([(s,) for s in sessions], "id long"), e, spark.createDataFrame(contents, "id long, text string"))
    assert {r.session_id: r.reason for r in got.collect() if r.reason} == brute(sessions, events, contents)


def test_edits_deletes_and_retries_fold(spark):
    """The last version counts: an edited role or text, a deleted answer, a retry under the same version, an edit that comes before its create."""
    schema = EV + ", version long, op string"
    events = [
        (1, 1, 1, 1, 0, "q", "user", "message", 1, "create"), (2, 1, 2, 2, 0, "a", "assistant", "message", 1, "create"), (3, 1, 3, 2, 0, "A", "assistant", "message", 2, "edit"),  # an edited answer
        (4, 2, 1, 1, 0, "q", "user", "message", 1, "create"), (5, 2, 2, 2, 0, "a", "assistant", "message", 1, "create"), (6, 2, 2, 2, 0, "a", "assistant", "message", 2, "delete"),  # its answer deleted
        (7, 3, 1, 1, 0, "q", "user", "message", 1, "create"), (8, 3, 3, 2, 0, "a", "assistant", "message", 5, "edit"), (9, 3, 2, 2, 0, "a", "assistant", "message", 1, "create"),  # out of order
        (10, 4, 1, 1, 0, "q", "user", "message", 1, "create"), (11, 4, 1, 1, 0, "q", "user", "message", 1, "retry"), (12, 4, 2, 2, 0, "a", "assistant", "message", 1, "create"),  # a retry
        (13, 5, 1, 1, 0, "q", "user", "message", None, "create"), (14, 5, 4, 1, 0, "q", "user", "message", 1, "edit"),  # edited to nothing
        (15, 6, 1, None, 0, None, "user", "message", None, None), (16, 6, 2, None, 0, None, "assistant", "message", None, None)]  # without ordinals
    contents = [(1, "ask"), (2, "old answer"), (3, "new answer"), (4, " ")]
    e, c = spark.createDataFrame(events, schema), spark.createDataFrame(contents, "id long, text string")
    s = spark.createDataFrame([(k,) for k in range(1, 7)], "id long")
    fold = (F.col("version"), F.col("op") == "delete")
    assert {r.session_id: r.reason for r in C.verdicts(s, e, c, *fold).collect()} == {1: None, 2: "no_reply", 3: None, 4: None, 5: "empty", 6: None}
    got = sorted((r.session_id, r.record_ordinal, r.role, r.parts, r.text) for r in C.rebuilt(s, e, c, *fold).collect())
    assert got == [(1, 1, "user", 1, "ask"), (1, 2, "assistant", 1, "new answer"), (3, 1, "user", 1, "ask"), (3, 2, "assistant", 1, "new answer"), (4, 1, "user", 1, "ask"), (4, 2, "assistant", 1, "old answer"),
                   (6, -1, "assistant", 1, "old answer"), (6, -1, "user", 1, "ask")]


def test_empty_tables(spark):
    e, c, s = spark.createDataFrame([], EV), spark.createDataFrame([], "id long, text string"), spark.createDataFrame([(1,)], "id long")
    assert [tuple(r) for r in C.verdicts(s, e, c).collect()] == [(1, "empty")]
    assert C.verdicts(s.where("false"), e, c).count() == 0
