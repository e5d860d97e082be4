"""The event store: duplicate occurrences, canonical events, session summaries, links between calls and results, listing and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstack.functions import text as T
from loomstack.functions.scalars import folded
from loomstack.operators import bm25
from loomstack.operators.timestamps import epoch_number
from loomstack.runtime import written

#: Chronological order of the events of a session.
ORDER = ("ts", "source_id", "record_ordinal", "part_ordinal", "id")
LIST_LIMIT, SEARCH_LIMIT, MAX_LIMIT = 100, 10, 50
OUTPUT_KINDS = ("command_output", "error", "test_failure")


def clean(events: DataFrame) -> DataFrame:
    """Events with their role folded, ``ts`` in milliseconds (0 = absent) and '' for missing texts."""
    role = folded(F.coalesce("role", F.lit("")))
    blank = {c: F.coalesce(c, F.lit("")) for c in ("native_event_id", "parent_native_id", "call_id", "tool_name", "kind") if c in events.columns}
    return events.withColumns({
        **blank, "role": F.when(role.isin("toolresult", "tool_result"), "tool").otherwise(role),
        "ts": F.coalesce(F.floor(epoch_number(F.col("ts"), F.lit("")) / 1000).cast("long"), F.lit(0))})


def occurrence_key() -> Column:
    """Two events of one content are the same occurrence if they share the call, else the native id, else time and parent."""
    return (F.when(F.col("call_id") != "", F.concat(F.lit("call\0"), "call_id")).when(F.col("native_event_id") != "", F.concat(F.lit("native\0"), "native_event_id"))
            .otherwise(F.concat(F.lit("time\0"), F.col("ts").cast("string"), F.lit("\0"), "parent_native_id")))


def duplicates(events: DataFrame) -> DataFrame:
    """``events`` with ``duplicate_of``: the id of the first occurrence, null for that one itself.

    The first of each key comes from a partial aggregation, so a hot key costs one row per task before the shuffle.
    """
    e = events.drop("duplicate_of").withColumn("_key", occurrence_key())
    first = e.groupBy("session_id", "content_id", "_key").agg(F.min(F.struct(*ORDER)).alias("_f")).select("session_id", "content_id", "_key", F.col("_f.id").alias("_first"))
    j = e.join(first, ["session_id", "content_id", "_key"])
    return j.withColumn("duplicate_of", F.when(F.col("_first") != F.col("id"), F.col("_first"))).drop("_key", "_first")


def canonical(events: DataFrame) -> DataFrame:
    """(content_id, event_id): the event that stands for a content, originals before duplicates."""
    return events.groupBy("content_id").agg(F.min(F.struct(F.col("duplicate_of").isNotNull().alias("dup"), *ORDER)).alias("s")).select("content_id", F.col("s.id").alias("event_id"))


def status_of(last_kind: Column, last_text: Column, count: Column) -> Column:
    done = F.lower(F.coalesce(last_text, F.lit(""))).isin("complete", "completed")
    return F.when(last_kind.isin("error", "test_failure"), "failed").when((last_kind == "status") & done, "complete").when(count > 0, "active").otherwise("unknown")


def summaries(sessions: DataFrame, events: DataFrame, contents: DataFrame) -> DataFrame:
    """(session_id, event_count, started_at, ended_at, status) of every session, from its events."""
    last = events.groupBy("session_id").agg(
        F.count("*").alias("event_count"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.max(F.struct(*ORDER[:-1], "id", "kind", "content_id")).alias("l"))
    last = last.select("session_id", "event_count", "started_at", "ended_at", F.col("l.kind").alias("kind"), F.col("l.content_id").alias("content_id"))
    last = last.join(contents.select(F.col("id").alias("content_id"), "text"), "content_id", "left")
    zero = F.lit(0).cast("long")
    return sessions.select(F.col("id").alias("session_id")).join(last, "session_id", "left").select(
        "session_id", *[F.coalesce(c, zero).alias(c) for c in ("event_count", "started_at", "ended_at")],
        status_of(F.col("kind"), F.col("text"), F.coalesce("event_count", zero)).alias("status"))


def call_links(events: DataFrame) -> DataFrame:
    """(id, linked_kind, kind): for each tool event with a call id, the kind of the latest (by time, then id) of the call's events with a lower id.

    An error that answers to a test is a failed test; other kinds stay.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("session_id", "call_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)  # one call: a handful of events
    linked = events.where("call_id <> ''").withColumn("_l", F.max(F.struct("ts", "id", "kind")).over(w)).where("role = 'tool' and _l is not null")
    kind = F.when((F.col("kind") == "error") & (F.col("_l.kind") == "test"), "test_failure").otherwise(F.col("kind"))
    return linked.select("id", F.col("_l.kind").alias("linked_kind"), kind.alias("kind"))


def last_outputs(events: DataFrame) -> DataFrame:
    """(session_id, call_id, output_id, exit_code, kind): the last output of each call among canonical events."""
    o = events.where((F.col("role") == "tool") & (F.col("call_id") != "") & F.col("kind").isin(*OUTPUT_KINDS) & F.col("duplicate_of").isNull())
    return o.groupBy("session_id", "call_id").agg(F.max(F.struct(*ORDER, "exit_code", "kind")).alias("s")).select(
        "session_id", "call_id", F.col("s.id").alias("output_id"), F.col("s.exit_code").alias("exit_code"), F.col("s.kind").alias("kind"))


def next_outputs(events: DataFrame) -> DataFrame:
    """(id, output_id): for each command or test, the chronologically first tool event of its call with a higher id; empty call ids match too.

    A command's call holds few events, but the empty call id gathers all events without one: instead of pairing them, each event sees
    the best candidate of those with higher ids through a running minimum, by blocks of ids.
    """
    from pyspark.sql import Window

    e = events.where("duplicate_of is null").select("session_id", "call_id", "id", "role", "kind", *[c for c in ORDER if c != "id"])
    e = e.withColumns({"_o": F.when(F.col("role") == "tool", F.struct(*ORDER)), "_b": F.floor(F.col("id") / 4096)})
    inside = Window.partitionBy("session_id", "call_id", "_b").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_near", F.min("_o").over(inside))
    blocks = e.groupBy("session_id", "call_id", "_b").agg(F.min("_o").alias("_m"))
    beyond = Window.partitionBy("session_id", "call_id").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_far", F.min("_m").over(beyond)).drop("_m")
    j = e.where(F.col("kind").isin("command", "test")).join(blocks, ["session_id", "call_id", "_b"], "left")
    return j.select("id", F.least("_near", "_far").alias("o")).where("o is not null").select("id", F.col("o.id").alias("output_id"))


def limit_of(value: int | None, fallback: int) -> int:
    return fallback if not value or value <= 0 else min(value, MAX_LIMIT)


def list_sessions(sessions: DataFrame, sources: DataFrame, *, agent=None, repository=None, project=None, workspace=None, lineage=None, from_ms=None, to_ms=None,
                  subagents: bool = False, limit: int | None = None) -> DataFrame:
    """Sessions by equality filters and overlap in time, latest end first, sub-agents hidden by default; flags those with a missing log."""
    s = sessions
    for column, value in (("agent", agent), ("repository", repository), ("project_id", project), ("workspace_id", workspace), ("task_lineage_id", lineage)):
        if value:
            s = s.where(F.col(column) == value)
    if not subagents:
        s = s.where("role_in_tree = 'root'")
    if from_ms is not None:
        s = s.where(F.col("ended_at") >= from_ms)
    if to_ms is not None:
        s = s.where(F.col("started_at") <= to_ms)
    s = s.orderBy(F.desc("ended_at"), "session_uid").limit(limit_of(limit, LIST_LIMIT))
    missing = sources.where("state = 'missing'").select("agent", F.col("native_session_id").alias("native_id")).distinct().withColumn("source_missing", F.lit(True))
    return s.join(missing, ["agent", "native_id"], "left").withColumn("source_missing", F.coalesce("source_missing", F.lit(False)))


def event_index(contents: DataFrame) -> DataFrame:
    """Term arrays of the contents; contents without any term are not part of the index."""
    body = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.coalesce("diff", F.lit("")))
    paths = F.array_join(F.coalesce(F.col("files"), F.array().cast("array<string>")), " ") if "files" in contents.columns else F.lit("")
    i = contents.select(F.col("id").alias("content_id"), T.text_terms(body).alias("body_terms"), T.text_terms(F.col("command")).alias("command_terms"), T.terms(T.path_terms(paths)).alias("file_terms"))
    # Written before the filter, which would otherwise be pushed below the analysis and repeat it.
    return written(i, "event_index").where((F.size("body_terms") > 0) | (F.size("command_terms") > 0) | (F.size("file_terms") > 0))


def search_events(index: DataFrame, events: DataFrame, sessions: DataFrame, query: str, *, kind=None, agent=None, session=None, repository=None, project=None, workspace=None, lineage=None, files: DataFrame | None = None, file=None,
                  from_ms=None, to_ms=None, limit: int | None = None, whole: bool = False) -> DataFrame:
    """Ranked event search. Statistics are those of the whole index; filters come after the match, one canonical event per content.

    ``session`` is a uid or a native id; ``file`` needs ``files`` (content_id, path); ``whole`` gives all hits, unordered.
    """
    hits = bm25.scored(index, T.query_phrases(query), bm25.EVENT_WEIGHTS).select("content_id", "score")
    per = events.groupBy("content_id").agg(F.min(F.struct(F.col("duplicate_of").isNotNull().alias("dup"), *ORDER, "session_id", "kind", "role")).alias("s"), F.count("*").alias("raw_event_count"))
    h = hits.join(per, "content_id").select("content_id", "score", "raw_event_count", F.col("s.id").alias("event_id"), F.col("s.ts").alias("ts"), F.col("s.session_id").alias("session_id"), F.col("s.kind").alias("kind"), F.col("s.role").alias("role"))
    h = h.join(sessions.select(F.col("id").alias("session_id"), "session_uid", "native_id", "agent", "repository", "project_id", "workspace_id", "task_lineage_id"), "session_id")
    for column, value in (("kind", kind), ("agent", agent), ("repository", repository), ("project_id", project), ("workspace_id", workspace), ("task_lineage_id", lineage)):
        if value:
            h = h.where(F.col(column) == value)
    if session:
        h = h.where((F.col("session_uid") == session) | (F.col("native_id") == session))
    if file:
        if files is None:
            raise ValueError("a file filter needs the files of the contents")
        h = h.join(files.where(F.col("path") == file).select("content_id").distinct(), "content_id", "left_semi")
    if from_ms is not None:
        h = h.where(F.col("ts") >= from_ms)
    if to_ms is not None:
        h = h.where(F.col("ts") <= to_ms)
    return h if whole else h.orderBy("score", "ts", "event_id").limit(limit_of(limit, SEARCH_LIMIT))


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge session rows by uid: titles and directories keep the first non-empty value, lineage takes the last, times widen.

    Both sides carry ``seq``, the order of arrival.
    """
    nonempty = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("seq", F.col(c).alias("v")))
    rows = old.unionByName(new)
    return rows.groupBy("session_uid").agg(
        *[F.coalesce(F.min(nonempty(c))["v"], F.lit("")).alias(c) for c in ("title", "cwd", "repository")],
        *[F.coalesce(F.max(nonempty(c))["v"], F.lit("")).alias(c) for c in ("task_lineage_id", "project_id")],
        F.coalesce(F.min(F.when(F.col("started_at") > 0, F.col("started_at"))), F.lit(0)).alias("started_at"), F.max("ended_at").alias("ended_at"))


def materialized(sessions_events: DataFrame) -> DataFrame:
    """Clean events with duplicates marked, written once for the several reads that follow."""
    return written(duplicates(clean(sessions_events)), "events")
