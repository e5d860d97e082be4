"""Episodes: slices of a session around an anchor event.

Anchors are errors, failed tests and corrections by their kind, and user messages that change the scope, set a direction, or restate an
earlier request. The restatement test compares a message with all earlier ones of its session; it runs on distinct texts in blocks of like
length, each pair of blocks that may hold a resemblance one matrix product, so no session is gathered in one place and no pair of rows is materialised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstack.operators.normalize import EDGE, trimmed
from loomstack.operators.ranks import ranked
from loomstack.operators.sessions import ORDER
from loomstack.runtime import written

# Words that mark a change of scope or a design direction.
SCOPE = rf"(?i)(?:{EDGE}scope{EDGE}|{EDGE}scoped{EDGE}|{EDGE}only{EDGE}|{EDGE}in scope{EDGE}|範囲|対象|含めない|除外)"
DESIGN = rf"(?i)(?:{EDGE}design{EDGE}|{EDGE}architecture{EDGE}|{EDGE}policy{EDGE}|{EDGE}use [a-z0-9_./-]+{EDGE}|方針|設計|規約|契約|〜にする|にする)"
SIMILAR = 0.8
BLOCK = 512
ANCHORS = ("user_correction", "error", "test_failure", "scope_revision", "design_direction", "requirement_restatement")


def requirement(c: Column) -> Column:
    """A message reduced to its letters and digits, in lower case."""
    return F.regexp_replace(F.lower(trimmed(c)), r"[^\p{L}\p{Nd}]", "")


def similarity(prior: str, current: str) -> float:
    """Share of the characters of ``prior`` that occur in ``current``, against the longer of the two."""
    if not prior or not current:
        return 0.0
    there = set(current)
    return sum(c in there for c in prior) / max(len(prior), len(current))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct texts of block ``cur`` that some earlier text of block ``pri`` resembles."""
    for batch in batches:
        scopes, texts = [], []
        for scope, cur, pri in zip(*(batch.column(n).to_pylist() for n in ("session_id", "cur", "pri"))):
            alphabet = {c: k for k, c in enumerate(sorted(set("".join(x["norm"] for x in cur) + "".join(x["norm"] for x in pri))))}
            count, there = np.zeros((len(pri), len(alphabet)), np.float32), np.zeros((len(cur), len(alphabet)), np.float32)
            for i, x in enumerate(pri):
                np.add.at(count[i], [alphabet[c] for c in x["norm"]], 1)
            for i, x in enumerate(cur):
                there[i, [alphabet[c] for c in set(x["norm"])]] = 1
            lc, lp = np.array([len(x["norm"]) for x in cur]), np.array([len(x["norm"]) for x in pri])
            spot = lambda x: tuple(x["at"].values()) if isinstance(x["at"], dict) else (x["at"],)
            place = {p: k for k, p in enumerate(sorted({spot(x) for x in (*cur, *pri)}))}
            ac, ap = (np.array([place[spot(x)] for x in side]) for side in (cur, pri))
            at = ac[:, None] > ap[None, :]
            hit = (there @ count.T >= SIMILAR * np.maximum(lc[:, None], lp[None, :]) - 1e-4) & at
            for i in np.flatnonzero(hit.any(axis=1)):
                scopes.append(scope)
                texts.append(cur[i]["norm"])
        yield pa.RecordBatch.from_arrays([pa.array(scopes, pa.int64()), pa.array(texts, pa.string())], ["session_id", "norm"])


def restatements(messages: DataFrame) -> DataFrame:
    """(id) of user messages that equal or resemble an earlier one of their session.

    ``messages``: (session_id, id, pos, text) of user messages and corrections, ``pos`` unique within a session. A text that occurs for the
    first time counts if an earlier text resembles it; a later occurrence counts because the first one equals it.
    """
    m = messages.select("session_id", "id", "pos", requirement(F.col("text")).alias("norm")).where("norm <> ''")
    first = written(m.groupBy("session_id", "norm").agg(F.min("pos").alias("at")), "requirements")
    placed = ranked(first.withColumn("size", F.length("norm")), ["session_id"], ["size", "norm"]).withColumn("b", F.floor((F.col("n") - 1) / BLOCK))
    blocks = written(placed.groupBy("session_id", "b").agg(
        F.collect_list(F.struct("at", "norm")).alias("texts"), F.min("size").alias("least"), F.max("size").alias("most"), F.min("at").alias("since"), F.max("at").alias("upto")), "blocks")
    cur = blocks.select("session_id", F.col("b").alias("c"), "least", "upto")
    pri = blocks.select("session_id", F.col("b").alias("p"), "most", "since")
    # An earlier text resembles a later one only if it has 0.8 of its length; pairs of blocks that cannot hold such texts are left out, the rest
    # is spread over the tasks pair by pair, however many of them one session has.
    meet = cur.join(pri, "session_id").where((F.col("most") >= SIMILAR * F.col("least") - 1e-4) & (F.col("since") < F.col("upto"))).select("session_id", "c", "p")
    texts = lambda k, name: blocks.select("session_id", F.col("b").alias(k), F.col("texts").alias(name))
    pairs = meet.join(texts("c", "cur"), ["session_id", "c"]).join(texts("p", "pri"), ["session_id", "p"]).select("session_id", "cur", "pri")
    like = pairs.mapInArrow(_similar, "session_id long, norm string").distinct().withColumn("like", F.lit(True))
    firsts = first.join(like, ["session_id", "norm"], "left")
    return m.join(firsts, ["session_id", "norm"]).where((F.col("pos") > F.col("at")) | F.col("like")).select("id")


def anchors(events: DataFrame, contents: DataFrame) -> DataFrame:
    """Canonical events with their ``anchor`` type, null for ordinary ones."""
    e = events.where("duplicate_of is null").join(contents.select(F.col("id").alias("content_id"), "text"), "content_id", "left")
    e = e.withColumn("text", F.coalesce("text", F.lit("")))
    said = e.where("role = 'user' and kind in ('message', 'user_correction')").select("session_id", "id", F.struct(*ORDER).alias("pos"), "text")
    again = restatements(said).withColumn("again", F.lit(True))
    plain = (F.col("role") == "user") & (F.col("kind") == "message") & (trimmed(F.col("text")) != "")
    return e.join(again, "id", "left").withColumn("anchor", F.when(F.col("kind").isin("user_correction", "error", "test_failure"), F.col("kind")).when(
        plain, F.when(F.col("text").rlike(SCOPE), "scope_revision").when(F.col("text").rlike(DESIGN), "design_direction").when(F.col("again"), "requirement_restatement"))).drop("again")


def task_status(session_status: Column, first_status: Column) -> Column:
    s, t = F.lower(F.coalesce(session_status, F.lit(""))), F.lower(F.coalesce(first_status, F.lit("")))
    return (F.when(s.isin("complete", "completed"), "complete").when(s == "failed", "failed").when(t.isin("complete", "completed"), "complete").when(t == "failed", "failed").otherwise("unknown"))


def episodes(anchored: DataFrame, sessions: DataFrame, *, from_ms=None, to_ms=None, anchor=None) -> DataFrame:
    """(episode_id, ts, anchor, session_uid, task_lineage_id, project_id, task_status): one row per anchor.

    The window of time applies after classification, so that earlier messages count as history.
    """
    telling = anchored.where(F.col("kind").eqNullSafe("status") & F.lower("text").isin("complete", "completed", "failed"))
    status = telling.groupBy("session_id").agg(F.min(F.struct(*ORDER, "text")).alias("s")).select("session_id", F.col("s.text").alias("first_status"))
    e = anchored.where("anchor is not null")
    if anchor:
        e = e.where(F.col("anchor") == anchor)
    if from_ms is not None:
        e = e.where(F.col("ts") >= from_ms)
    if to_ms is not None:
        e = e.where(F.col("ts") <= to_ms)
    s = sessions.select(F.col("id").alias("session_id"), "session_uid", "task_lineage_id", "project_id", F.col("status").alias("_status"))
    return e.join(s, "session_id").join(status, "session_id", "left").select(
        F.concat_ws(":", "session_uid", F.col("id").cast("string"), "anchor").alias("episode_id"), F.col("id").alias("event_id"), "ts", "anchor", "session_uid", "task_lineage_id", "project_id",
        task_status(F.col("_status"), F.col("first_status")).alias("task_status"))


def summary(eps: DataFrame) -> DataFrame:
    """One row: distinct episodes, sessions, lineages and projects, and counts by anchor and by status as maps."""
    d = eps.groupBy("episode_id").agg(F.first("session_uid").alias("s"), F.first("task_lineage_id").alias("l"), F.first("project_id").alias("p"), F.first("anchor").alias("a"), F.first("task_status").alias("t"))
    some = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    flat = d.agg(F.count("*").alias("episodes"), F.count_distinct("s").alias("sessions"), F.count_distinct(some("l")).alias("task_lineages"), F.count_distinct(some("p")).alias("projects"),
                 *[F.count(F.when(F.col("a") == a, 1)).alias(a) for a in ANCHORS], *[F.count(F.when(F.col("t") == t, 1)).alias(f"status_{t}") for t in ("complete", "failed", "unknown")])
    return flat


def placed(anchored: DataFrame) -> DataFrame:
    """Events with their place ``n`` in the session and its number of events ``of``."""
    return ranked(anchored, ["session_id"], list(ORDER))


def frame_rows(events: DataFrame, before: int, after: int | None) -> DataFrame:
    """(anchor_id, anchor_n, id, n) of the events from ``before`` places ahead of each anchor to ``after`` behind it; None: to the end of the session.

    ``events`` come from ``placed``. A bounded frame asks for its places by number and meets them in an equality join on (session, place), so
    a session of any length is no single task. A frame to the end of the session is as long as that: its rows are the result.
    """
    if before < 0 or (after or 0) < 0:
        raise ValueError("bounds of a frame must not be negative")
    last = F.col("of") if after is None else F.least(F.col("of"), F.col("n") + after)
    wanted = events.where("anchor is not null").select(
        "session_id", F.col("id").alias("anchor_id"), F.col("n").alias("anchor_n"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - before), last)).alias("n"))
    return wanted.join(events.select("session_id", "n", "id"), ["session_id", "n"]).select("anchor_id", "anchor_n", "id", "n")


def frames(anchored: DataFrame, before: int, after: int | None) -> DataFrame:
    """(event_id, anchor, frame): ids of the events of each anchor's frame in order; None for ``after``: to the end of the session."""
    e = placed(anchored)
    ids = frame_rows(e, before, after).groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("frame"))
    return ids.join(e.where("anchor is not null").select(F.col("id").alias("anchor_id"), "anchor"), "anchor_id").select(F.col("anchor_id").alias("event_id"), "anchor", "frame")


def matched(anchored: DataFrame, hits: DataFrame) -> DataFrame:
    """(event_id, matched): anchors with the ids of the ``hits`` (hit) from the anchor to the end of its session, if there are any.

    Places in the session are compared, so that no frame is collected; a search returns few hits, so these are sent to the anchors.
    """
    at = anchored.join(F.broadcast(hits.select(F.col("hit").alias("id"))), "id", "left_semi").select("session_id", F.col("id").alias("hit"), F.struct(*ORDER).alias("hit_at"))
    a = anchored.where("anchor is not null").select("session_id", F.col("id").alias("event_id"), F.struct(*ORDER).alias("anchor_at"))
    return a.join(F.broadcast(at), "session_id").where("anchor_at <= hit_at").groupBy("event_id").agg(F.sort_array(F.collect_set("hit")).alias("matched"))


def outcome(kind: Column, code: Column) -> Column:
    return F.when(kind.isin("error", "test_failure") | F.coalesce(code != 0, F.lit(False)), "failure").when(F.coalesce(code == 0, F.lit(False)), "success").otherwise("unknown")
