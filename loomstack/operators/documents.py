"""Nested documents about sessions and episodes, from the event store.

A document lists observed events, each tied to its source. Sections are cut to byte budgets by running sums (no session is sorted in one
task), and only what a budget leaves is gathered into arrays, so a document of a session of any length stays small. What must see a whole
section in order (the digest of all diffs of a session, the greedy choice of an episode's events) is a stream over sorted rows that keeps a
bounded state.

Defined results: '' and null texts are absent; times not after the epoch are ''; sections without items are empty arrays; events without
a source have a null one, or raise an error where the caller is strict; sessions without events have no document.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstack.operators import episodes as E
from loomstack.operators import sessions as S
from loomstack.operators.evidence import BUDGETS, within_budget
from loomstack.operators.normalize import DIFF_LIMIT, MARKER
from loomstack.runtime import written

EVIDENCE_VERSION, EPISODE_VERSION = "session-evidence/v1", "transcript-episode/v1"
MAX_DOCUMENT = 1 << 20
#: Sources of a section of diffs: so many from either end.
ENDS = 16
# What a status says of a task.
SUCCESS, FAILURE = ("complete", "completed", "success", "succeeded"), ("failed", "failure")


def format_millis(ms: Column) -> Column:
    """RFC 3339 in UTC without trailing zeros of the fraction; '' for absent times."""
    t = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    short = F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(ms > 0, F.concat(short, F.lit("Z"))).otherwise("")


def files_of(diff: Column) -> Column:
    """Paths that a diff changes, distinct and sorted."""
    marks = F.regexp_extract_all(F.coalesce(diff, F.lit("")), F.lit(r"(?m)^(?:\+\+\+ b/|\*\*\* (?:Add File|Update File|Delete File|Move to): )([^\r\n]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(marks, lambda p: F.trim(p)), lambda p: p != "")))


def content_files(contents: DataFrame) -> DataFrame:
    """(content_id, path): what each content touches, where the store keeps no list of its own."""
    return contents.where("coalesce(diff, '') <> ''").select(F.col("id").alias("content_id"), F.explode(files_of(F.col("diff"))).alias("path"))


def joined_paths(files: DataFrame, sep: str) -> DataFrame:
    """(content_id, paths): the paths of each content in order, joined."""
    return files.groupBy("content_id").agg(F.array_join(F.array_sort(F.collect_set("path")), sep).alias("paths"))


def touching(events: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Events whose content touches a path."""
    return events.join(files.where(F.col("path") == path).select("content_id").distinct(), "content_id", "left_semi")


def full_events(events: DataFrame, contents: DataFrame, sources: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Events with payload, files and source: what a session shows. ``files``: (content_id, path)."""
    have = set(contents.columns)
    payload = [F.col("id").alias("content_id"), *([F.col("content_hash")] if "content_hash" in have else [F.lit("").alias("content_hash")])]
    for x in ("text", "command", "diff"):
        value = F.coalesce(x, F.lit(""))
        size = F.coalesce(F.col(f"{x}_original_bytes").cast("long"), F.lit(0)) if f"{x}_original_bytes" in have else F.lit(0)
        digest = F.coalesce(f"{x}_sha256", F.lit("")) if f"{x}_sha256" in have else F.lit("")
        payload += [value.alias(x), F.struct(
            value.alias("text"), (F.coalesce(f"{x}_truncated", F.lit(False)) if f"{x}_truncated" in have else F.lit(False)).alias("truncated"),
            F.when(size > 0, size).otherwise(F.octet_length(value)).cast("long").alias("original_bytes"), F.when(digest != "", digest).otherwise(F.sha2(value, 256)).alias("sha256")).alias(f"{x}_evidence")]
    paths = (content_files(contents) if files is None else files).groupBy("content_id").agg(F.array_sort(F.collect_set("path")).alias("files"))
    src = sources.select(F.col("id").alias("source_id"), F.coalesce("path", F.lit("")).alias("_path"), F.coalesce("content_hash", F.lit("")).alias("_hash"), F.coalesce("state", F.lit("")).alias("_state"))
    col = lambda n, kind: F.col(n).cast(kind) if n in events.columns else F.lit(None).cast(kind)
    none = F.array().cast("array<string>")
    j = events.join(contents.select(*payload), "content_id", "left").join(paths, "content_id", "left").join(src, "source_id", "left")
    source = F.when(F.col("_path").isNotNull(), F.struct(
        F.col("_path").alias("path"), F.when(F.coalesce(col("source_hash", "string"), F.lit("")) != "", col("source_hash", "string")).otherwise(F.col("_hash")).alias("hash"),
        F.coalesce(col("source_line", "long"), F.lit(0)).alias("line"), F.coalesce(col("byte_offset", "long"), F.lit(0)).alias("byte_offset"), F.col("_state").alias("state")))
    return j.withColumns({
        "source": source, "files": F.coalesce("files", none), "timestamp": format_millis(F.col("ts")), **{x: F.coalesce(x, F.lit("")) for x in ("text", "command", "diff")}}).drop("_path", "_hash", "_state")


def json_size(item: Column) -> Column:
    """Bytes of an item as web-safe JSON, and the comma behind it."""
    text = F.to_json(item)
    return F.octet_length(text) + 5 * (F.length(text) - F.length(F.translate(text, "<>&", ""))) + 1


def _section(items: DataFrame, name: str, budget: int) -> DataFrame:
    """(session_id, name, omitted_name): items in order within the budget, and how many that left out. ``items``: session_id, ORDER, item."""
    sized = items.withColumn("size", json_size(F.col("item")))
    kept = within_budget(sized, "session_id", list(S.ORDER), F.col("size"), budget)
    arrays = kept.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*S.ORDER, "item"))), lambda x: x["item"]).alias(name))
    total = sized.groupBy("session_id").agg(F.count("*").alias("_n"))
    return arrays.join(total, "session_id").select("session_id", name, (F.col("_n") - F.size(name)).alias(f"omitted_{name}"))


def bounded_bytes(head: bytes, tail: bytes, total: int, limit: int) -> tuple[str, bool]:
    """(text, truncated) of a text of ``total`` bytes, of which at least ``limit`` from either end are given."""
    if total <= limit:
        return (head if len(head) >= total else head + tail[len(head) - total:]).decode("utf-8", "replace"), False
    budget = limit - len(MARKER.encode())
    front, back = head[:budget // 2], tail[len(tail) - (budget - budget // 2):]
    return front.decode("utf-8", "ignore") + MARKER + back.decode("utf-8", "ignore").lstrip("�"), True


_SOURCE = pa.struct([("path", pa.string()), ("hash", pa.string()), ("line", pa.int64()), ("byte_offset", pa.int64()), ("state", pa.string())])
_SOURCE_DDL = "struct<path:string,hash:string,line:long,byte_offset:long,state:string>"


class _Diffs:
    """What is kept of the diffs of one session while they stream by."""

    def __init__(self, session: int, limit: int):
        self.session, self.limit, self.total, self.digest = session, limit, 0, hashlib.sha256()
        self.head, self.tail, self.first, self.last, self.count = bytearray(), bytearray(), [], deque(maxlen=ENDS), 0

    def add(self, diff: str, source: dict) -> None:
        data = (b"\n" if self.count else b"") + diff.encode()
        self.digest.update(data)
        self.total += len(data)
        self.count += 1
        self.head += data[:max(self.limit + 4 - len(self.head), 0)]
        self.tail = (self.tail + data)[-self.limit - 4:]
        if len(self.first) < ENDS:
            self.first.append(source)
        else:
            self.last.append(source)

    def row(self) -> dict:
        text, cut = bounded_bytes(bytes(self.head), bytes(self.tail), self.total, self.limit)
        unique = {(s["path"], s["hash"], s["line"], s["byte_offset"]): s for s in [*self.first, *self.last] if s}
        sources = sorted(unique.values(), key=lambda s: (s["path"], s["line"], s["byte_offset"]))
        return {"session_id": self.session, "diff": {"text": text, "truncated": cut, "original_bytes": self.total, "sha256": self.digest.hexdigest(), "sources": sources}, "omitted_diff_sources": max(self.count - 2 * ENDS, 0)}


def diff_sections(events: DataFrame, limit: int = DIFF_LIMIT) -> DataFrame:
    """(session_id, diff, omitted_diff_sources): all diffs of a session in order as one bounded text with the digest of the whole, and the first and last sources."""
    schema = pa.schema([("session_id", pa.int64()), ("diff", pa.struct([("text", pa.string()), ("truncated", pa.bool_()), ("original_bytes", pa.int64()), ("sha256", pa.string()), ("sources", pa.list_(_SOURCE))])), ("omitted_diff_sources", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _Diffs | None = None
        for batch in batches:
            done = []
            for session, diff, source in zip(*(batch.column(n).to_pylist() for n in ("session_id", "diff", "source"))):
                if state is None or session != state.session:
                    if state:
                        done.append(state.row())
                    state = _Diffs(session, limit)
                state.add(diff, source)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if state:
            yield pa.RecordBatch.from_pylist([state.row()], schema=schema)

    kind = f"session_id long, diff struct<text:string,truncated:boolean,original_bytes:long,sha256:string,sources:array<{_SOURCE_DDL}>>, omitted_diff_sources long"
    return events.where("diff <> ''").select("session_id", "diff", "source", *S.ORDER).repartition("session_id").sortWithinPartitions("session_id", *S.ORDER).mapInArrow(scan, kind)


def session_evidence(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """One evidence document per session with events: schema_version, session, task, user_inputs, commands, files_changed, errors, diff, final_response, omitted.

    ``events`` come from ``full_events``, duplicates marked.
    """
    one = events.where("duplicate_of is null")
    order = list(S.ORDER)
    observed = lambda kind: F.struct(F.col("text_evidence.text").alias("text"), F.col("text_evidence.truncated").alias("truncated"), F.col("text_evidence.original_bytes").alias("original_bytes"),
                                     F.col("text_evidence.sha256").alias("sha256"), kind.alias("kind"), F.col("timestamp"), F.col("source"))
    asked = one.where("role = 'user' and kind in ('message', 'user_correction') and text <> ''").withColumn(
        "item", observed(F.when(F.col("kind") == "user_correction", "correction").otherwise("request"))).select("session_id", *order, "item")
    answers = one.where("role = 'assistant' and kind = 'message' and text <> ''").withColumn("item", observed(F.lit(None).cast("string")))
    out = S.last_outputs(events).select("session_id", "call_id", "output_id")
    results = one.select(F.col("id").alias("output_id"), F.col("kind").alias("_kind"), F.col("exit_code").alias("_code"), F.col("text").alias("_text"), F.col("text_evidence").alias("_evidence"), F.col("source").alias("_source"))
    commands = one.where("kind in ('command', 'test') and command <> ''").join(out, ["session_id", "call_id"], "left").join(results, "output_id", "left")
    shown = F.coalesce(F.col("_text") != "", F.lit(False))
    commands = commands.withColumn("item", F.struct(
        F.col("command_evidence").alias("command"), "kind", F.when(F.col("_kind").isNull(), "unknown").otherwise(E.outcome(F.col("_kind"), F.col("_code"))).alias("outcome"), F.col("_code").alias("exit_code"),
        F.when(shown, F.col("_evidence")).alias("output"), F.when(shown, F.col("_source")).alias("output_source"), "timestamp", "source")).select("session_id", *order, "item")
    changed = one.where("kind = 'file_operation'").select("session_id", *order, "timestamp", "source", F.explode("files").alias("path"))
    changed = changed.groupBy("session_id", "path").agg(F.min(F.struct(*order, "timestamp", "source")).alias("s")).select("session_id", *[F.col(f"s.{c}").alias(c) for c in order], F.struct("path", "s.timestamp", "s.source").alias("item"))
    errors = one.where("kind in ('error', 'test_failure')").withColumn("item", F.struct("kind", F.col("text_evidence").alias("text"), "timestamp", "source")).select("session_id", *order, "item")
    doc = events.groupBy("session_id").agg(F.count_if(F.col("duplicate_of").isNotNull()).alias("omitted_duplicate_events"))
    first = asked.groupBy("session_id").agg(F.min(F.struct(*order, "item"))["item"].alias("task"))
    final = answers.groupBy("session_id").agg(F.max(F.struct(*order, "item"))["item"].alias("final_response"))
    parts = [first, final, _section(asked, "user_inputs", BUDGETS["user"]), _section(commands, "commands", BUDGETS["command"]), _section(changed, "files_changed", BUDGETS["file"]),
             _section(errors, "errors", BUDGETS["error"]), diff_sections(one.where("kind = 'file_operation'"))]
    for p in parts:
        doc = doc.join(p, "session_id", "left")
    has = lambda n: F.coalesce(n, F.lit("")) if n in sessions.columns else F.lit("")
    info = sessions.select(F.col("id").alias("session_id"), F.struct(
        F.col("session_uid").alias("id"), has("native_id").alias("native_id"), has("agent").alias("agent"), has("parent_session_id").alias("parent_session_id"), has("role_in_tree").alias("role_in_tree"), has("repository").alias("repository"),
        format_millis(F.col("started_at")).alias("started_at"), format_millis(F.col("ended_at")).alias("ended_at"), has("status").alias("status"), F.coalesce("event_count", F.lit(0)).alias("event_count")).alias("session"))
    doc = doc.join(info, "session_id")
    empty = lambda n, items: F.coalesce(n, F.array().cast(items.schema["item"].dataType.simpleString().join(("array<", ">")))).alias(n)
    zero = F.lit(0).cast("long")
    no_diff = F.struct(F.lit("").alias("text"), F.lit(False).alias("truncated"), zero.alias("original_bytes"), F.sha2(F.lit(""), 256).alias("sha256"), F.array().cast(f"array<{_SOURCE_DDL}>").alias("sources"))
    return doc.select(
        F.lit(EVIDENCE_VERSION).alias("schema_version"), "session", "task", empty("user_inputs", asked), empty("commands", commands), empty("files_changed", changed), empty("errors", errors), F.coalesce("diff", no_diff).alias("diff"), "final_response",
        F.struct(*[F.coalesce(f"omitted_{n}", zero).cast("long").alias(n) for n in ("user_inputs", "commands", "files_changed", "errors", "diff_sources", "duplicate_events")]).alias("omitted"))


def checked_size(documents: DataFrame, limit: int = MAX_DOCUMENT) -> DataFrame:
    """``documents``, failing at one whose JSON is over the limit in spite of its budgets."""
    size = json_size(F.struct(*documents.columns)) - 1
    return documents.where(F.when(size <= limit, True).otherwise(F.raise_error(F.concat(F.lit("a document exceeds the limit: "), size.cast("string"))).cast("boolean")))


# ---- episodes ---------------------------------------------------------------------------------------------------------------
def _evidence_of(x: str) -> list[Column]:
    e = F.col(f"{x}_evidence")
    cut = e["truncated"]
    return [F.when(F.col(x) != "", F.col(x)).alias(x), F.when(cut, True).alias(f"{x}_truncated"), F.when(cut, e["original_bytes"]).alias(f"{x}_original_bytes"),
            F.when(cut, F.greatest(e["original_bytes"] - F.octet_length(e["text"]), F.lit(0))).alias(f"{x}_omitted_bytes"), F.when(cut, e["sha256"]).alias(f"{x}_sha256")]


def event_evidence(strict: bool = True) -> Column:
    """The projection of an event that episodes show; absent fields are null."""
    source = F.col("source")
    if strict:
        whole = source.isNotNull() & (F.trim(source["path"]) != "") & (F.trim(source["hash"]) != "")
        source = F.when(whole, source).otherwise(F.raise_error(F.concat(F.lit("event without a whole source: "), F.col("id").cast("string"))).cast(_SOURCE_DDL))
    return F.struct(
        F.col("id").alias("event_id"), F.col("kind").alias("event_type"), "role", F.when(F.col("timestamp") != "", F.col("timestamp")).alias("timestamp"), *_evidence_of("text"), *_evidence_of("command"), *_evidence_of("diff"),
        F.when(F.size("files") > 0, F.col("files")).alias("files"), "exit_code", F.when(F.coalesce("content_hash", F.lit("")) != "", F.col("content_hash")).alias("content_hash"), source.alias("source"))


def event_outcomes(events: DataFrame) -> DataFrame:
    """(id, result): what an event tells about success: of commands and tests what their call's first later tool event tells."""
    nxt = S.next_outputs(events).join(events.select(F.col("id").alias("output_id"), F.col("kind").alias("_kind"), F.col("exit_code").alias("_code")), "output_id").select("id", "_kind", "_code")
    e = events.where(F.col("kind").isin("command", "test", "command_output", "test_failure", "error", "status")).join(nxt, "id", "left")
    said = F.lower(F.trim("text"))
    linked = F.when(F.coalesce(F.col("_code") == 0, F.lit(False)), "success").when(F.col("_kind").isin("error", "test_failure") | F.col("_code").isNotNull(), "failure").otherwise("unknown")
    result = (F.when(F.col("kind").isin("error", "test_failure") | F.coalesce(F.col("exit_code") != 0, F.lit(False)), "failure").when(F.coalesce(F.col("exit_code") == 0, F.lit(False)), "success")
              .when(F.col("kind") == "status", F.when(said.isin(*SUCCESS), "success").when(said.isin(*FAILURE), "failure").otherwise("unknown"))
              .when(F.col("kind").isin("command", "test"), linked).otherwise("unknown"))
    return e.select("id", result.alias("result"))


def within_frame_budget(rows: DataFrame, budget: int) -> DataFrame:
    """``rows`` (anchor_id, anchor_n, id, n, size) with ``kept``: in order while they fit; the first and the anchor always. No budget (0) keeps all.

    What is kept depends on all before it, so a frame streams through one task, in order, with two numbers as state.
    """
    if not budget:
        return rows.withColumn("kept", F.lit(True))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, used, any_kept = None, 0, False
        for b in batches:
            kept = []
            for a, an, n, size in zip(*(b.column(c).to_pylist() for c in ("anchor_id", "anchor_n", "n", "size"))):
                if a != anchor:
                    anchor, used, any_kept = a, 0, False
                ok = n == an or used + size <= budget or not any_kept
                used, any_kept = used + size * ok, any_kept or ok
                kept.append(ok)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("anchor_id", "anchor_n", "id", "n", "size")), pa.array(kept, pa.bool_())], ["anchor_id", "anchor_n", "id", "n", "size", "kept"])

    r = rows.select("anchor_id", *[F.col(c).cast("long").alias(c) for c in ("anchor_n", "id", "n", "size")])
    return r.repartition("anchor_id").sortWithinPartitions("anchor_id", "n").mapInArrow(scan, "anchor_id long, anchor_n long, id long, n long, size long, kept boolean")


def episode_documents(anchored: DataFrame, sessions: DataFrame, before: int = 0, after: int | None = None, byte_budget: int = 0, token_budget: int = 0, only: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """One document per anchor: schema_version, episode_id, ids of session and project, trigger, context_before, corrections, actions_after, outcomes, final_report, task_status, source_event_ids, omitted.

    ``anchored``: events from ``full_events`` without duplicates, with their ``anchor``; ``after`` None: to the end of the session; a token
    counts as 4 bytes; ``only``: (id) of the anchors that are asked for.
    """
    if byte_budget < 0 or token_budget < 0:
        raise ValueError("budgets must not be negative")
    budget = min([b for b in (byte_budget, token_budget * 4) if b], default=0)
    events = E.placed(anchored.withColumn("item", event_evidence(strict)))
    wanted = events if only is None else events.join(only.select("id").distinct().withColumn("_asked", F.lit(True)), "id", "left").withColumn("anchor", F.when(F.col("_asked"), F.col("anchor"))).drop("_asked")
    results = event_outcomes(anchored)
    body = events.join(results, "id", "left").select(
        "id", "item", "role", "kind", "text", "source", "result", F.octet_length(F.to_json("item")).cast("long").alias("size"), F.col("anchor").isin("user_correction", "requirement_restatement", "scope_revision", "design_direction").alias("correcting"))
    body = written(body, "bodies")
    rows = E.frame_rows(wanted, before, after).join(body.select("id", "size"), "id")
    rows = written(within_frame_budget(rows, budget), "frames")
    lost = rows.where("not kept").groupBy("anchor_id").agg(
        F.count("*").alias("_events"), F.sum("size").alias("_bytes"), F.sum(F.floor((F.col("size") + 3) / 4)).alias("_tokens"), F.count_if(F.col("n") < F.col("anchor_n")).alias("_context_before"), F.count_if(F.col("n") > F.col("anchor_n")).alias("_actions_after"))
    full = rows.where("kept").join(body, "id")
    here, behind = F.col("n") == F.col("anchor_n"), F.col("n") > F.col("anchor_n")
    told = F.struct(F.col("id").alias("event_id"), F.col("kind").alias("type"), F.col("result").alias("outcome"), F.when(F.col("text") != "", F.col("text")).alias("text"), "source")
    listed = lambda value, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("n", value.alias("v"))))), lambda x: x["v"])
    item = F.col("item")
    status = F.when(F.col("kind") == "status", F.when(F.lower("text").isin("complete", "completed"), "complete").when(F.lower("text") == "failed", "failed"))
    docs = full.groupBy("anchor_id").agg(
        listed(item, F.col("n") < F.col("anchor_n")).alias("context_before"), listed(item, here | (behind & (F.col("role") == "user") & F.coalesce("correcting", F.lit(False)))).alias("corrections"), listed(item, behind).alias("actions_after"),
        listed(told, F.col("result").isNotNull()).alias("outcomes"), F.max(F.when(behind & (F.col("role") == "assistant") & (F.col("kind") == "message"), F.struct("n", "item")))["item"].alias("final_report"),
        F.min(F.when(status.isNotNull(), F.struct("n", status.alias("v"))))["v"].alias("_said"), listed(F.col("id"), F.lit(True)).alias("source_event_ids"))
    a = events.where("anchor is not null").select(F.col("id").alias("anchor_id"), "session_id", "anchor", "timestamp")
    has = lambda n: F.coalesce(n, F.lit("")).alias(n) if n in sessions.columns else F.lit("").alias(n)
    s = sessions.select(F.col("id").alias("session_id"), "session_uid", has("native_id"), has("task_lineage_id"), has("project_id"), has("workspace_id"), F.lower(has("status")).alias("_status"))
    zero = F.lit(0).cast("long")
    done = F.when(F.col("_status").isin("complete", "completed"), "complete").when(F.col("_status") == "failed", "failed").otherwise(F.coalesce("_said", F.lit("unknown")))
    return docs.join(a, "anchor_id").join(s, "session_id").join(lost, "anchor_id", "left").select(
        F.lit(EPISODE_VERSION).alias("schema_version"), F.concat_ws(":", "session_uid", F.col("anchor_id").cast("string"), "anchor").alias("episode_id"), F.col("session_uid").alias("transcript_id"), F.col("native_id").alias("native_session_id"),
        "task_lineage_id", "project_id", "workspace_id", F.struct(F.col("anchor").alias("type"), F.col("anchor_id").alias("event_id"), "timestamp").alias("trigger"), "context_before", "corrections", "actions_after", "outcomes", "final_report",
        done.alias("task_status"), "source_event_ids", F.struct(*[F.coalesce(f"_{c}", zero).cast("long").alias(c) for c in ("events", "bytes", "tokens", "context_before", "actions_after")]).alias("omitted"))


def split_episode_id(episode_id: str) -> tuple[str, int, str]:
    """(session uid, event id, anchor type); the uid may hold colons itself."""
    parts = episode_id.rsplit(":", 2)
    if len(parts) < 3 or not parts[1].isdigit() or int(parts[1]) <= 0:
        raise ValueError(f"invalid episode id {episode_id!r}")
    return parts[0], int(parts[1]), parts[2]


def episode_by_id(anchored: DataFrame, sessions: DataFrame, episode_id: str, **bounds) -> DataFrame:
    """The document of one episode; an error if its event is no anchor of that type any more."""
    uid, event, _ = split_episode_id(episode_id)
    mine = sessions.where(F.col("session_uid") == uid)
    events = anchored.join(mine.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    doc = written(episode_documents(events, mine, only=events.where(F.col("id") == event).select("id"), **bounds), "episode")
    found = [r["episode_id"] for r in doc.select("episode_id").limit(1).collect()]
    if found != [episode_id]:
        raise ValueError(f"episode {episode_id!r} " + ("does not match the stored anchor" if found else "not found"))
    return doc


def search_summary(hits: DataFrame) -> DataFrame:
    """One row: raw events, distinct sessions, lineages and projects of search hits; '' counts for nothing."""
    some = lambda c: F.count_distinct(F.when(F.coalesce(c, F.lit("")) != "", F.col(c)))
    return hits.agg(F.coalesce(F.sum("raw_event_count"), F.lit(0)).alias("raw_events"), some("session_uid").alias("sessions"), some("task_lineage_id").alias("task_lineages"), some("project_id").alias("projects"))
