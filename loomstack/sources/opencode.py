"""A transcript store in SQLite: sessions, messages and parts, one logical source per session."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.sources.logs import ROLES, _as_dict, exit_code, tool_call

#: Columns that the three tables must have.
REQUIRED = {"session": {"id", "project_id", "parent_id", "directory", "title", "time_created", "time_updated"},
            "message": {"id", "session_id", "time_created", "time_updated", "data"}, "part": {"id", "message_id", "session_id", "time_created", "time_updated", "data"}}


def open_store(path: str) -> sqlite3.Connection:
    """Open read-only and check the schema."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    for name, columns in REQUIRED.items():
        missing = columns - {r[1] for r in db.execute(f"pragma table_info({name})")}
        if missing:
            raise ValueError(f"table {name} lacks {', '.join(sorted(missing))}")
    return db


#: Rows that one task reads of a table.
RANGE = 200_000


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three tables as DataFrames; ranges of rows are read by the executors, which see the file where the driver does."""
    out = {}
    for name, columns in REQUIRED.items():
        cols = sorted(columns)
        with closing(open_store(path)) as db:
            low, high = db.execute(f"select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from {name}").fetchone()
        starts = spark.range(low, high + 1, RANGE, numPartitions=max(1, -(-(high + 1 - low) // RANGE)))
        kinds = [pa.int64() if c.startswith("time_") else pa.string() for c in cols]

        def scan(batches: Iterator[pa.RecordBatch], name=name, cols=cols, kinds=kinds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in batch.column("id").to_pylist():
                    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
                        rows = db.execute(f"select {', '.join(cols)} from {name} where rowid >= ? and rowid < ?", (start, start + RANGE))
                        while part := rows.fetchmany(10_000):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], cols)

        out[name] = starts.mapInArrow(scan, ", ".join(f"{c} {'long' if c.startswith('time_') else 'string'}" for c in cols))
    return out


def sources(t: dict[str, DataFrame]) -> DataFrame:
    """One logical source per session; its version is the latest update of the session, its messages and its parts."""
    latest = t["message"].select("session_id", "time_updated").unionByName(t["part"].select("session_id", "time_updated")).groupBy("session_id").agg(F.max("time_updated").alias("u"))
    s = t["session"].join(latest, F.col("id") == F.col("session_id"), "left")
    return s.select(F.concat(F.lit("opencode/"), "id").alias("logical_id"), F.col("id").alias("native_session_id"), F.coalesce("parent_id", F.lit("")).alias("parent"), "project_id", F.col("directory").alias("cwd"), "title",
                    F.col("time_created").alias("started_at"), F.greatest("time_updated", F.coalesce("u", F.lit(0))).cast("string").alias("external_version"))


def decode_part(role: str, data: str) -> list[dict]:
    """Records of one part: a text, a tool call with its response, or a patch."""
    p = _as_dict(json.loads(data))
    kind = p.get("type")
    if kind == "text":
        return [{"role": role, "kind": "message", "text": p.get("text") or ""}]
    if kind == "tool":
        state, name, call = _as_dict(p.get("state")), p.get("tool") or "", p.get("callID") or ""
        out = [{"role": "assistant", "kind": "tool", "tool_name": name, "call_id": call} | tool_call(state.get("input"))]
        text = state.get("output") if isinstance(state.get("output"), str) else state.get("error") or ""
        if state.get("status") in ("completed", "error"):
            code = 1 if state.get("status") == "error" else exit_code(text)
            out.append({"role": "tool", "kind": "command_output", "tool_name": name, "call_id": call, "text": text, "exit_code": code})
        return out
    if kind == "patch":
        return [{"role": role, "kind": "file_operation", "paths": sorted(f for f in p.get("files") or [] if isinstance(f, str)), "text": p.get("hash") or ""}]
    return []


def parts(t: dict[str, DataFrame]) -> DataFrame:
    """Parts with the role of their message, in order: (session_id, record_ordinal, part_id, message_id, time_created, role, data)."""
    from pyspark.sql import Window

    m = t["message"].select(F.col("id").alias("message_id"), "session_id", F.lower(F.get_json_object("data", "$.role")).alias("role"))
    j = t["part"].join(m, ["message_id", "session_id"]).where(F.col("role").isin(*ROLES))
    w = Window.partitionBy("session_id").orderBy("time_created", "id")
    return j.select("session_id", F.row_number().over(w).cast("long").alias("record_ordinal"), F.col("id").alias("part_id"), "message_id", "time_created", "role", "data")


def content_version(t: dict[str, DataFrame]) -> DataFrame:
    """(session_id, hash): changes with any part of a session; a changed hash rebuilds the session."""
    p = parts(t).withColumn("h", F.sha2(F.concat_ws("\0", "part_id", "role", "data"), 256))
    return p.groupBy("session_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_ordinal", "h"))), lambda x: x["h"]), ""), 256).alias("hash"))


_RECORDS = "session_id string, record_ordinal long, part_ordinal long, part_id string, message_id string, time_created long, role string, kind string, tool_name string, call_id string, exit_code int, text string, command string, diff string, paths array<string>"


def records(t: dict[str, DataFrame]) -> DataFrame:
    """Records of all parts in order; parts that are no JSON or of no known kind give none."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _RECORDS.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
        schema = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, _RECORDS.split(", "))])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    found = decode_part(r["role"], r["data"])
                except (ValueError, TypeError):
                    continue
                rows += [dict.fromkeys(names, "") | {"exit_code": None, "paths": []} | {k: r[k] for k in names[:2] + names[3:6]} | {"part_ordinal": k} | x for k, x in enumerate(found)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return parts(t).mapInArrow(scan, _RECORDS)


def changed(versions: DataFrame, stored: DataFrame) -> DataFrame:
    """Sources whose version is not the stored one, or that are new: (logical_id, external_version) against the same of the store."""
    known = stored.select("logical_id", F.col("external_version").alias("_was"))
    return versions.join(known, "logical_id", "left").where(~F.col("external_version").eqNullSafe(F.col("_was"))).drop("_was")
