"""The session store: agent logs on disk become sessions, contents and events that stay.

A sync pass is one batch. Logs are discovered under the agents' folders; executors look at each (size, time, guard, first lines) and tell
whether it is unchanged, has grown, or is another one; what is new is read there, decoded, normalised, linked to the calls that it answers, and
written as the batch: events, contents, sessions, and the state of all logs. A batch counts from the moment its mark is written, so a pass that
dies leaves nothing behind. Replacing what a log held before needs no deletion: events carry the generation of their log, and readers see
only the generation that the last batch names.

Ids follow the order of logs and lines within a batch and the order of batches, so a lower id is an earlier arrival. What can be derived
(duplicates, summaries, canonical events) is derived from the events when read, by the same operators as for any event table, so a store that grew in
steps tells the same as one built at once.

Defined results: a log that cannot be read is an error of its own and stops no other; an incomplete last line waits for the next pass; blank
and oversized lines are noise, malformed ones are counted; records without a text, command or path that are no status are dropped; a time that is
missing or unreadable is the session's start, else the log's; a log that is gone is marked missing and its events stay; an empty folder gives
empty tables.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstack import project
from loomstack.operators import normalize as N
from loomstack.operators import sessions as S
from loomstack.runtime import hadoop_fs, scratch, written
from loomstack.sources import logs
from loomstack.streaming import tail

#: Lines that are read for what a log says about its session.
HEADER_LINES = 64
SOURCES = ("source_id long, agent string, path string, native_session_id string, parent string, lineage string, cwd string, title string, started_at long, generation long, size long, mtime_ns long, file_id string, "
           "cursor_offset long, cursor_ordinal long, guard string, content_hash string, state string, last_error string, malformed long")
PLAN = ("agent string, path string, plan string, error string, native_session_id string, parent string, lineage string, cwd string, title string, started_at long, size long, mtime_ns long, file_id string, "
        "start_offset long, start_ordinal long, end_offset long, end_ordinal long, guard string, content_hash string")
EVENTS = ("id long, session_uid string, content_key string, source_id long, generation long, record_ordinal long, part_ordinal long, byte_offset long, source_line long, native_event_id string, parent_native_id string, ts long, role string, kind string, "
          "tool_name string, call_id string, exit_code int, source_hash string")
_PAYLOAD = [f"{x}{y}" for x in ("text", "command", "diff") for y in ("", "_truncated", "_original_bytes", "_sha256")]
CONTENTS = "content_id long, content_key string, session_uid string, content_hash string, " + ", ".join(
    f"{x} string, {x}_truncated boolean, {x}_original_bytes long, {x}_sha256 string" for x in ("text", "command", "diff")) + ", files array<string>"
SESSIONS = "session_id long, seq long, session_uid string, agent string, native_id string, parent_session_id string, role_in_tree string, title string, cwd string, repository string, project_id string, workspace_id string, task_lineage_id string, started_at long, ended_at long"
TABLES = {"events": EVENTS, "contents": CONTENTS, "sessions": SESSIONS, "sources": SOURCES}
#: An id: the batch, the partition, the place in it.
BATCH, PART = 44, 28


def agent_folders(home: str, environment: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Where the agents keep their logs; some can be told by the environment."""
    env = environment or {}
    codex = env.get("CODEX_HOME") or os.path.join(home, ".codex")
    return {"codex": [os.path.join(codex, "sessions"), os.path.join(codex, "archived_sessions")], "claude": [os.path.join(env.get("CLAUDE_CONFIG_DIR") or os.path.join(home, ".claude"), "projects")],
            "cursor": [os.path.join(home, ".cursor", "projects")], "pi": [env.get("PI_CODING_AGENT_SESSION_DIR") or os.path.join(home, ".pi", "agent", "sessions")]}


def discover(folders: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(agent, path) of every log, in order; only names are listed here, files are looked at by the executors."""
    found = []
    for agent, roots in folders.items():
        for root in roots:
            for at, _, names in os.walk(root):
                found += [(agent, os.path.join(at, n)) for n in names if n.lower().endswith(".jsonl")]
    return sorted(f for f in found if f[0] != "cursor" or "/agent-transcripts/" in f[1].replace(os.sep, "/"))


def _first(*values) -> str:
    return next((v.strip() for v in values if isinstance(v, str) and v.strip()), "")


def header(agent: str, path: str) -> dict:
    """What the first lines of a log say about its session; the name of the file tells where they say nothing."""
    import json

    parts = path.replace(os.sep, "/").split("/")
    out = {"native_session_id": os.path.splitext(parts[-1])[0], "parent": parts[parts.index("subagents") - 1] if "subagents" in parts[1:] else "", "lineage": "", "cwd": "", "title": "", "started": ""}
    known = {"native_session_id": False, "cwd": False}
    with open(path, "rb") as f:
        for line, _ in zip(f, range(HEADER_LINES)):
            try:
                d = json.loads(line)
            except ValueError:
                continue
            if not isinstance(d, dict):
                continue
            p = d.get("payload") if isinstance(d.get("payload"), dict) else {}
            own = _first(p.get("session_id"), p.get("id")) if d.get("type") == "session_meta" else _first(d.get("id")) if d.get("type") == "session" else _first(d.get("sessionId"))
            links = [x.get(k) for x in (p, d) for k in ("parent_session_id", "parentSessionId", "parent_id", "continuation_of", "forked_from")]
            cwd = _first(p.get("cwd"), d.get("cwd"))
            out["parent"] = out["parent"] or _first(*links)
            out["lineage"] = out["lineage"] or _first(p.get("task_lineage_id"), d.get("task_lineage_id"))
            out["title"], out["started"] = _first(d.get("title")) or out["title"], out["started"] or _first(p.get("timestamp"), d.get("timestamp"))
            for k, v in (("native_session_id", own), ("cwd", cwd)):
                if v:
                    out[k], known[k] = v, True
            if all(known.values()):
                break
    return out


def _millis(text: str) -> int:
    import datetime as dt

    try:
        t = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
        return int((t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)).timestamp() * 1000)
    except ValueError:
        return 0


def _digest(path: str, size: int) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while size and (block := f.read(min(size, 1 << 20))):
            h.update(block)
            size -= len(block)
    return h.hexdigest()


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One plan row per log: 'unchanged', 'extend', 'rebuild', 'new' or 'error'."""
    names = [c.split()[0] for c in PLAN.split(", ")]
    schema = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.string()) for c in PLAN.split(", ")])
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            out = dict.fromkeys(names) | {"agent": r["agent"], "path": r["path"], "error": ""}
            try:
                st = os.stat(r["path"])
                out |= {"size": st.st_size, "mtime_ns": st.st_mtime_ns, "file_id": f"{st.st_dev}:{st.st_ino}"}
                h = header(r["agent"], r["path"])
                out |= {k: h[k] for k in ("native_session_id", "parent", "lineage", "cwd", "title")} | {"started_at": _millis(h["started"])}
                known = r["source_id"] is not None
                if known and (r["size"], r["mtime_ns"]) == (st.st_size, st.st_mtime_ns) and r["state"] != "error":
                    plan, start, ordinal = "unchanged", r["cursor_offset"], r["cursor_ordinal"]
                else:
                    grown = known and r["file_id"] == out["file_id"] and st.st_size >= r["cursor_offset"] and tail.guard(r["path"], r["cursor_offset"]) == r["guard"]
                    plan, start, ordinal = ("extend", r["cursor_offset"], r["cursor_ordinal"]) if grown else ("rebuild" if known else "new", 0, 0)
                end, lines = tail.complete_prefix(r["path"], start) if plan != "unchanged" else (start, 0)
                changed = plan != "unchanged"
                out |= {"plan": plan, "start_offset": start, "start_ordinal": ordinal, "end_offset": end, "end_ordinal": ordinal + lines,
                        "guard": tail.guard(r["path"], end) if changed else r["guard"], "content_hash": _digest(r["path"], end) if changed else r["content_hash"]}
            except OSError as e:
                out |= {"plan": "error", "error": e.strerror or str(e)}
            rows.append(out)
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Complete lines of the planned ranges."""
    schema = pa.schema([("logical_id", pa.string()), ("record_ordinal", pa.int64()), ("byte_offset", pa.int64()), ("line", pa.string())])
    for batch in batches:
        for r in batch.to_pylist():
            at, ordinal, rows, size = r["start_offset"], r["start_ordinal"], [], 0
            with open(r["path"], "rb") as f:
                f.seek(at)
                while at < r["end_offset"]:
                    line = f.readline()
                    ordinal += 1
                    rows.append({"logical_id": r["path"], "record_ordinal": ordinal, "byte_offset": at, "line": line.rstrip(b"\r\n").decode("utf-8", "replace")})
                    at, size = at + len(line), size + len(line)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        folders = batch.column("cwd").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("cwd"), *map(pa.array, zip(*map(project.resolve, folders)))] if folders else [pa.array([], pa.string())] * 4, ["cwd", "repository", "project_id", "workspace_id"])


def with_ids(df: DataFrame, batch: int, order: list[str], name: str) -> DataFrame:
    """``df`` with ids that follow ``order`` and the batches."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (batch << BATCH) + (TaskContext.get().partitionId() << PART) + 1
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + b.num_rows)), *b.columns], [name, *b.schema.names])
            at += b.num_rows

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ", ".join([f"{name} long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)])
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, kinds)


class SessionStore:
    """A store under ``state``. Logs and state lie where all executors see them."""

    def __init__(self, spark: SparkSession, state: str):
        self.spark, self.state = spark, state.rstrip("/")

    def _path(self, *parts) -> str:
        return "/".join([self.state, *map(str, parts)])

    def batches(self) -> list[int]:
        fs, at = hadoop_fs(self.spark, self._path("batches"))
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".done")) for n in names if n.endswith(".done"))

    def _all(self, name: str) -> DataFrame:
        parts = [self.spark.read.schema(TABLES[name]).parquet(self._path("batches", b, name)) for b in self.batches()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], TABLES[name])

    # ---- reading ------------------------------------------------------------------------------------------------------------
    def sources(self) -> DataFrame:
        """The state of all logs after the last pass."""
        done = self.batches()
        return self.spark.read.schema(SOURCES).parquet(self._path("batches", done[-1], "sources")) if done else self.spark.createDataFrame([], SOURCES)

    def _live(self) -> DataFrame:
        return self._all("events").join(self.sources().select("source_id", "generation"), ["source_id", "generation"], "left_semi")

    def events(self) -> DataFrame:
        """Events with session_id, content_id and ``duplicate_of``."""
        ids = self._all("sessions").groupBy("session_uid").agg(F.min("session_id").alias("session_id"))
        e = self._live().join(ids, "session_uid").join(self._all("contents").select("content_key", "content_id"), "content_key")
        return S.duplicates(e.drop("session_uid", "content_key"))

    def contents(self) -> DataFrame:
        """Contents that some event refers to, with the files that they touch."""
        return self._all("contents").join(self._live().select("content_key").distinct(), "content_key", "left_semi").withColumnRenamed("content_id", "id")

    def content_files(self) -> DataFrame:
        return self.contents().select(F.col("id").alias("content_id"), F.explode("files").alias("path"))

    def sessions(self) -> DataFrame:
        """Sessions that have events, merged from all passes in the order of arrival, with their summaries."""
        s = self._all("sessions")
        keep = S.upserted(s.where("false"), s)
        fixed = s.groupBy("session_uid").agg(
            F.min("session_id").alias("id"), F.first("agent").alias("agent"), F.first("native_id").alias("native_id"), F.coalesce(F.max(F.when(F.col("parent_session_id") != "", F.struct("seq", "parent_session_id")))["parent_session_id"], F.lit("")).alias("parent_session_id"),
            F.max(F.col("role_in_tree") == "subagent").alias("_sub"), F.coalesce(F.min(F.when(F.col("workspace_id") != "", F.struct("seq", "workspace_id")))["workspace_id"], F.lit("")).alias("workspace_id"))
        rows = fixed.join(keep.drop("started_at", "ended_at"), "session_uid").withColumn("role_in_tree", F.when(F.col("_sub"), "subagent").otherwise("root")).drop("_sub")
        summary = S.summaries(rows, self.events(), self.contents())
        return rows.join(summary.withColumnRenamed("session_id", "id"), "id").where("event_count > 0")

    # ---- a pass -------------------------------------------------------------------------------------------------------------
    def _plans(self, found: list[tuple[str, str]]) -> DataFrame:
        known = self.sources().drop("native_session_id", "parent", "lineage", "cwd", "title", "started_at")
        names = self.spark.createDataFrame(found, "agent string, path string") if found else self.spark.createDataFrame([], "agent string, path string")
        spread = max(1, min(len(found), 8 * self.spark.sparkContext.defaultParallelism))
        return written(names.join(known, ["agent", "path"], "left").repartition(spread).mapInArrow(_prepared, PLAN), "plans")

    def _records(self, plans: DataFrame) -> DataFrame:
        """Decoded, normalised records of what is to be read, with the counts of their lines."""
        todo = plans.where("plan in ('new', 'extend', 'rebuild')")
        spread = 4 * self.spark.sparkContext.defaultParallelism
        parts = []
        for agent in logs.DECODERS:
            mine = todo.where(F.col("agent") == agent).select("path", "start_offset", "start_ordinal", "end_offset").repartition(spread, "path")
            lines = mine.mapInArrow(_lines, "logical_id string, record_ordinal long, byte_offset long, line string")
            parts.append(logs.records(lines, agent).withColumn("agent", F.lit(agent)))
        return written(N.normalized(reduce(DataFrame.unionByName, parts)), "records")

    def sync(self, folders: dict[str, list[str]], dry_run: bool = False, fail_before_mark: bool = False) -> dict:
        """One pass over the agents' folders; returns its counts. ``dry_run`` reads and decodes all logs but writes nothing."""
        found = discover(folders)
        done = self.batches()
        batch = (done[-1] if done else 0) + 1
        reader = SessionStore(self.spark, scratch(self.spark, "nothing")) if dry_run else self
        plans = reader._plans(found)
        records = self._records(plans)
        keep = records.where(F.coalesce(N.retained(F.coalesce("kind", F.lit("")), F.coalesce("text", F.lit("")), F.coalesce("command", F.lit("")), "paths"), F.lit(False)) & F.col("role").isNotNull())
        count = {r["plan"]: r["count"] for r in plans.groupBy("plan").count().collect()}
        lines = records.agg(*[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in ("malformed", "noise", "reasoning", "unknown")]).first()
        stats = {"sources_found": len(found), "sources_read": sum(count.get(p, 0) for p in ("new", "extend", "rebuild")), "sources_unchanged": count.get("unchanged", 0), "sources_rebuilt": count.get("rebuild", 0), "sources_missing": 0,
                 "malformed": lines["malformed"], "skipped_noise": lines["noise"], "skipped_reasoning": lines["reasoning"], "skipped_unknown": lines["unknown"],
                 "errors": [r.asDict() for r in plans.where("plan = 'error'").select("agent", "path", "error").collect()]}
        if dry_run:
            return stats | {"events_added": keep.count()}
        old = self.sources()
        sources = self._next_sources(batch, old, plans, records)
        missing = old.where("state <> 'missing'").select("source_id").join(sources.where("state = 'missing'").select("source_id"), "source_id", "left_semi")
        stats["sources_missing"] = missing.count()
        events = written(self._next_events(batch, sources, keep), "events")
        stats["events_added"] = events.count()
        self._write(batch, events, sources)
        if fail_before_mark:
            raise RuntimeError("stopped before the mark")
        fs, at = hadoop_fs(self.spark, self._path("batches", f"{batch}.done"))
        fs.create(at, True).close()
        return stats

    def _next_sources(self, batch: int, old: DataFrame, plans: DataFrame, records: DataFrame) -> DataFrame:
        bad = records.groupBy(F.col("logical_id").alias("path")).agg(F.sum(F.col("malformed").cast("long")).alias("_bad"))
        new = with_ids(plans.join(old.select("agent", "path"), ["agent", "path"], "left_anti").select("agent", "path"), batch, ["agent", "path"], "new_id")
        j = plans.join(old.select("agent", "path", "source_id", "generation", F.col("malformed").alias("_was"), *[F.col(c).alias(f"_{c}") for c in ("cursor_offset", "cursor_ordinal", "guard", "content_hash", "size", "mtime_ns", "file_id", "native_session_id", "parent", "lineage", "cwd", "title", "started_at")]), ["agent", "path"], "left")
        j = j.join(new, ["agent", "path"], "left").join(bad, "path", "left")
        failed = F.col("plan") == "error"
        zero = F.lit(0).cast("long")
        held = lambda c, n=None: F.when(failed, F.coalesce(F.col(f"_{c}"), F.lit("") if n is None else zero)).otherwise(F.col(n or c)).alias(c)
        seen = j.select(
            F.coalesce("source_id", "new_id").alias("source_id"), "agent", "path", *[held(c) for c in ("native_session_id", "parent", "lineage", "cwd", "title")], held("started_at", "started_at"),
            (F.coalesce("generation", zero) + F.when(F.col("plan") == "rebuild", 1).otherwise(0)).alias("generation"), held("size", "size"), held("mtime_ns", "mtime_ns"), held("file_id"),
            held("cursor_offset", "end_offset"), held("cursor_ordinal", "end_ordinal"), held("guard"), held("content_hash"),
            F.when(failed, "error").otherwise("ok").alias("state"), F.col("error").alias("last_error"), (F.coalesce("_was", zero) + F.coalesce("_bad", zero)).alias("malformed"))
        gone = old.join(plans.select("agent", "path"), ["agent", "path"], "left_anti").withColumns({"state": F.lit("missing"), "last_error": F.lit("source not found")})
        return written(seen.unionByName(gone.select(seen.columns)), "sources")

    def _next_events(self, batch: int, sources: DataFrame, records: DataFrame) -> DataFrame:
        src = sources.select("source_id", "generation", F.col("path").alias("logical_id"), F.col("native_session_id").alias("_native"), F.col("content_hash").alias("source_hash"), F.col("cwd").alias("_cwd"), "parent", "lineage", "title", F.col("started_at").alias("_started"), (F.col("mtime_ns") / 1_000_000).cast("long").alias("_mtime"))
        r = records.join(src, "logical_id")
        # Where a line names no session, the decoder gives what follows the first slash of the log's name.
        said = F.when(F.col("native_session_id") == F.expr("substring(logical_id, instr(logical_id, '/') + 1)"), None).otherwise(F.when(F.col("native_session_id") != "", F.col("native_session_id")))
        ts = F.unix_millis(F.try_to_timestamp("timestamp"))
        r = r.withColumns({
            "session_uid": F.concat_ws(":", "agent", F.coalesce(said, "_native")), "native_id": F.coalesce(said, "_native"),
            "ts": F.coalesce(F.when(ts > 0, ts), F.when(F.col("_started") > 0, F.col("_started")), F.col("_mtime")), "cwd": F.when(F.coalesce("cwd", F.lit("")) != "", F.col("cwd")).otherwise(F.col("_cwd"))})
        known = self._all("events").select("source_id", "generation", "record_ordinal", "part_ordinal")
        r = r.join(known, ["source_id", "generation", "record_ordinal", "part_ordinal"], "left_anti").drop("id")
        r = written(with_ids(r, batch, ["agent", "logical_id", "record_ordinal", "part_ordinal"], "id"), "numbered")
        # A failed result is a failed test if the latest earlier event of its call is a test; earlier batches count too.
        calls = r.where("call_id <> ''").select("session_uid", "call_id", "id", "ts", "kind", "role", F.lit(True).alias("fresh"))
        before = self._live().where("call_id <> ''").join(calls.select("session_uid", "call_id").distinct(), ["session_uid", "call_id"], "left_semi").select("session_uid", "call_id", "id", "ts", "kind", "role", F.lit(False).alias("fresh"))
        w = Window.partitionBy("session_uid", "call_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        failed = calls.unionByName(before).withColumn("_l", F.max(F.struct("ts", "id", "kind")).over(w)).where("fresh and role = 'tool' and kind = 'error' and _l.kind = 'test'").select("id", F.lit("test_failure").alias("_kind"))
        r = r.join(failed, "id", "left").withColumn("kind", F.coalesce("_kind", "kind"))
        blank = F.lit("")
        r = r.withColumn("content_hash", N.content_hash(*[F.col(c) for c in ("role", "kind", "text", "text_sha256", "command", "command_sha256", "diff", "diff_sha256", "paths")]))
        return r.withColumns({"content_key": F.sha2(F.concat_ws("\0", "session_uid", "content_hash"), 256), "source_line": F.col("record_ordinal"), **{c: F.coalesce(c, blank) for c in ("native_event_id", "parent_native_id", "tool_name", "call_id")}})

    def _write(self, batch: int, events: DataFrame, sources: DataFrame) -> None:
        cols = lambda kinds: [c.split()[0] for c in kinds.split(", ")]
        events.select(*cols(EVENTS)).write.mode("overwrite").parquet(self._path("batches", batch, "events"))
        sources.select(*cols(SOURCES)).write.mode("overwrite").parquet(self._path("batches", batch, "sources"))
        first = Window.partitionBy("content_key").orderBy("id")  # the few occurrences of one content
        c = events.withColumn("_k", F.row_number().over(first)).where("_k = 1").join(self._all("contents").select("content_key"), "content_key", "left_anti")
        c = with_ids(c.select("content_key", "session_uid", "content_hash", *[F.col(p).cast("long").alias(p) if p.endswith("bytes") else F.col(p) for p in _PAYLOAD], F.col("paths").alias("files"), "id"), batch, ["id"], "content_id")
        c.select(*cols(CONTENTS)).write.mode("overwrite").parquet(self._path("batches", batch, "contents"))
        s = events.groupBy("session_uid", "source_id").agg(
            F.min("id").alias("seq"), F.first("agent").alias("agent"), F.first("native_id").alias("native_id"), F.first("parent").alias("parent"), F.first("lineage").alias("lineage"), F.first("title").alias("title"),
            F.coalesce(F.min(F.when(F.col("cwd") != "", F.struct("id", "cwd")))["cwd"], F.lit("")).alias("cwd"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
        places = s.select("cwd").distinct().mapInArrow(_identities, "cwd string, repository string, project_id string, workspace_id string")
        s = written(s.join(places, "cwd").withColumn("parent_session_id", F.when(F.col("parent") != "", F.concat_ws(":", "agent", "parent")).otherwise("")), "sessions")
        known = self._all("sessions").groupBy("session_uid").agg(F.min(F.struct("session_id", "task_lineage_id")).alias("s"))
        own = known.select("session_uid", F.col("s.session_id").alias("_id"))
        above = known.select(F.col("session_uid").alias("parent_session_id"), F.col("s.task_lineage_id").alias("_above"))
        fresh = with_ids(s.select("session_uid").distinct().join(own, "session_uid", "left_anti"), batch, ["session_uid"], "_new")
        line = lambda c: F.concat(F.lit("task:"), F.sha2(F.concat_ws("\0", "project_id", c), 256))
        s = s.join(own, "session_uid", "left").join(fresh, "session_uid", "left").join(above, "parent_session_id", "left").withColumns({
            "session_id": F.coalesce("_id", "_new"), "role_in_tree": F.when(F.col("parent_session_id") != "", "subagent").otherwise("root"),
            "task_lineage_id": F.when(F.col("lineage") != "", F.col("lineage")).when(F.coalesce("_above", F.lit("")) != "", F.col("_above")).when(F.col("parent_session_id") != "", line("parent_session_id")).otherwise(line("session_uid"))})
        s.select(*cols(SESSIONS)).write.mode("overwrite").parquet(self._path("batches", batch, "sessions"))

    def reindex(self, folders: dict[str, list[str]]) -> dict:
        """Forget everything and read all logs again; refused before anything is removed if there is no log."""
        if not discover(folders):
            raise RuntimeError("no logs found; the store is left as it is")
        fs, at = hadoop_fs(self.spark, self._path("batches"))
        fs.delete(at, True)
        stats = self.sync(folders)
        if stats["errors"]:
            raise RuntimeError(f"{len(stats['errors'])} logs could not be read")
        return stats
