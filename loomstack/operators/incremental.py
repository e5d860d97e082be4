"""Problem 1: read only what is new, exactly once, whatever fails on the way.

Log-based change capture: every log is a partition of the change stream with its own offset (generation, bytes and lines read, and the
SHA-256 of exactly those bytes). A run

1. compares the offsets with the lines now there and writes a *plan* to the shared folder before any row reaches the sink: the rows to
   read themselves, and the offsets that hold once they are read. A run that finds a plan without commit replays it as it stands,
2. hands the planned rows to the sink, which deduplicates by (log, generation, ordinal), so a replay adds nothing twice,
3. commits by marking the plan's offsets as the current ones.

As the plan holds rows and offsets, a replay never looks at the logs again: whatever happens to them between failure and replay (appends,
rewrites with the same or other record ids, truncation, removal) is seen by the next run, which compares with the offsets that belong to the
rows in the sink. The price is that planned rows are written twice, once ahead and once into the sink.

The hash cannot be combined from parts (SHA-256 is a chain), so it is computed by streaming: rows are partitioned by log and sorted by
ordinal, the log's offset leading its lines, and one pass over Arrow batches keeps one running hash. The same pass compares the prefix and
goes on to the hash of all complete lines, which is the next offset's. Memory is one batch, whatever the length of a log; a log that
holds a third of all rows takes one task's time at hash speed (some 300 MB a second) but is never held anywhere.

Defined results: a log without offset is read whole; null lines count as empty; an unterminated last line is never read; rows
of logs that are gone or without a name yield nothing; null or negative cursors count as 0; rows that repeat an ordinal of their log count once
(the lowest record id); with an empty table on either side the result is all terminated rows, or none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.runtime import hadoop_fs, scratch, table

LINE_COLUMNS = ("record_id", "logical_id", "record_ordinal", "byte_offset", "terminated", "line")
OFFSETS = "logical_id string, generation long, cursor_offset long, cursor_ordinal long, content_hash string"
_STATE = pa.schema([("logical_id", pa.string()), ("same", pa.bool_()), ("generation", pa.int64()), ("read_to", pa.int64()), ("cursor_offset", pa.int64()), ("cursor_ordinal", pa.int64()), ("content_hash", pa.string())])


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the two raw log tables, in one shape."""
    return table(spark, sf_dir, "codex", *LINE_COLUMNS).unionByName(table(spark, sf_dir, "pi", *LINE_COLUMNS))


def source_offsets(sources: DataFrame) -> DataFrame:
    """OFFSETS from the store's view of its logs; of several rows of a log the furthest counts."""
    return sources.where("logical_id is not null").groupBy("logical_id").agg(
        F.max_by(F.struct("cursor_offset", "cursor_ordinal", "content_hash"), F.struct("cursor_offset", "id")).alias("s")
    ).select("logical_id", F.lit(0).cast("long").alias("generation"), F.col("s.cursor_offset").cast("long").alias("cursor_offset"), F.col("s.cursor_ordinal").cast("long").alias("cursor_ordinal"), "s.content_hash")


class _Log:
    """The running hash of one log."""

    def __init__(self, name: str | None):
        self.name, self.known, self.generation, self.cursor, self.read_to, self.wanted = name, False, 0, 0, 0, None
        self.digest, self.seen, self.same, self.ordinal = hashlib.sha256(), 0, None, None
        self.end, self.last, self.complete = 0, 0, None  # bytes, lines and hash up to the last complete line; no hash if that is all

    def offset(self, generation: int | None, cursor: int | None, ordinal: int | None, wanted: str | None) -> None:
        self.known, self.generation = True, generation or 0
        self.cursor, self.read_to, self.wanted = max(cursor or 0, 0), max(ordinal or 0, 0), (wanted or "").lower()

    def line(self, ordinal: int, text: str | None, ended: bool) -> None:
        if ordinal == self.ordinal:
            return
        self.ordinal = ordinal
        data = (text or "").encode() + (b"\n" if ended else b"")
        if self.same is None and self.known and self.seen + len(data) >= self.cursor:
            head = self.digest.copy()
            head.update(data[:self.cursor - self.seen])
            self.same = head.hexdigest() == self.wanted
        if ended:
            self.end, self.last, self.complete = self.seen + len(data), ordinal, None
        elif self.complete is None:
            self.complete = self.digest.copy()
        self.seen += len(data)
        self.digest.update(data)

    def row(self) -> tuple:
        """State of the log: a new generation starts where the bytes read are no longer there."""
        if self.same is None:  # shorter than what was read, or without lines
            self.same = self.known and self.digest.hexdigest() == self.wanted and self.seen == self.cursor
        keep = self.known and self.same
        return (self.name, keep, self.generation + (self.known and not keep), self.read_to if keep else 0, self.end, self.last, (self.complete or self.digest).hexdigest())


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each log that has lines, from one running hash over its sorted rows; an offset leads them with a null ``terminated``."""
    log: _Log | None = None
    for batch in batches:
        done = []
        names, ordinals, ended, texts = (batch.column(n).to_pylist() for n in ("logical_id", "record_ordinal", "terminated", "line"))
        marks = [batch.column(n).to_pylist() for n in ("generation", "cursor_offset", "cursor_ordinal", "content_hash")]
        for i, name in enumerate(names):
            if log is None or name != log.name:
                if log is not None and log.ordinal is not None:
                    done.append(log.row())
                log = _Log(name)
            if ended[i] is None:
                log.offset(*(m[i] for m in marks))
                continue
            log.line(ordinals[i], texts[i], ended[i])
        yield pa.RecordBatch.from_pylist([dict(zip(_STATE.names, r)) for r in done], schema=_STATE)
    if log is not None and log.ordinal is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(_STATE.names, log.row()))], schema=_STATE)


def log_states(lines: DataFrame, offsets: DataFrame) -> DataFrame:
    """(logical_id, same, generation, read_to, cursor_offset, cursor_ordinal, content_hash) of every log that has lines.

    ``same`` tells whether the bytes before the stored cursor are still those that were read, ``read_to`` the ordinal beyond which rows
    are new; the rest is the offset after all complete lines are read.
    """
    null = lambda kind: F.lit(None).cast(kind)
    rows = lines.where("logical_id is not null").select(
        "logical_id", F.coalesce("record_ordinal", F.lit(0)).cast("long").alias("record_ordinal"), F.coalesce("terminated", F.lit(False)).alias("terminated"), "line",
        *[null(k).alias(n) for n, k in (("generation", "long"), ("cursor_offset", "long"), ("cursor_ordinal", "long"), ("content_hash", "string"))])
    marks = offsets.where("logical_id is not null").select(
        "logical_id", F.lit(-(2**62)).cast("long").alias("record_ordinal"), null("boolean").alias("terminated"), null("string").alias("line"), "generation", "cursor_offset", "cursor_ordinal", "content_hash")
    kinds = "logical_id string, same boolean, generation long, read_to long, cursor_offset long, cursor_ordinal long, content_hash string"
    return rows.unionByName(marks).repartition("logical_id").sortWithinPartitions("logical_id", "record_ordinal").mapInArrow(_states, kinds)


def planned(lines: DataFrame, states: DataFrame) -> DataFrame:
    """The rows to read next: LINE_COLUMNS as far as there are, ``generation`` and ``mode`` ('append' or 'rebuild').

    A rebuild replaces what the sink holds of that log, an append adds to it.
    """
    s = states.select("logical_id", "same", "generation", "read_to")
    rows = lines.select(*[c for c in LINE_COLUMNS if c in lines.columns]).where("terminated and logical_id is not null").join(s, "logical_id")
    return rows.where(F.coalesce("record_ordinal", F.lit(0)) > F.when(F.col("same"), F.col("read_to")).otherwise(F.lit(-(2**62)))).withColumn(
        "mode", F.when(F.col("same"), "append").otherwise("rebuild")).drop("same", "read_to")


def log_digests(lines: DataFrame) -> DataFrame:
    """(logical_id, content_hash): SHA-256 of the complete lines of every log that has any, streamed."""
    none = lines.sparkSession.createDataFrame([], OFFSETS)
    return log_states(lines.where("terminated"), none).select("logical_id", "content_hash")


class IncrementalSync:
    """Runs batches over a state folder: ``plans/N`` the write-ahead plan (``rows``, ``offsets``), ``sink/N`` the rows, ``commits/N`` the mark.

    A plan counts once its own mark is written, a batch once it is committed. A run that dies leaves a plan without commit; the next run
    replays that plan, overwrites ``sink/N`` and commits. The offsets of a plan are those of all logs, so a commit is a mark and no merge.
    """

    def __init__(self, spark: SparkSession, state: str):
        self.spark, self.state = spark, state.rstrip("/")

    def _path(self, *parts: str | int) -> str:
        return "/".join([self.state, *map(str, parts)])

    def _marked(self, kind: str) -> list[int]:
        fs, at = hadoop_fs(self.spark, self._path(kind))
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".done")) for n in names if n.endswith(".done"))

    def _mark(self, kind: str, batch: int) -> None:
        fs, at = hadoop_fs(self.spark, self._path(kind, f"{batch}.done"))
        fs.create(at, True).close()

    def offsets(self, batch: int) -> DataFrame:
        """The offsets after a batch."""
        return self.spark.read.schema(OFFSETS).parquet(self._path("plans", batch, "offsets"))

    def _plan(self, batch: int, lines: DataFrame, offsets: DataFrame) -> None:
        states = log_states(lines, offsets)
        states.write.mode("overwrite").parquet(self._path("plans", batch, "states"))
        states = self.spark.read.schema(states.schema).parquet(self._path("plans", batch, "states"))
        planned(lines, states).withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(self._path("plans", batch, "rows"))
        # A log that is gone keeps its offset: should it come back unchanged, nothing of it is read again.
        moved = states.select("logical_id", "generation", "cursor_offset", "cursor_ordinal", "content_hash")
        kept = offsets.select("logical_id", "generation", "cursor_offset", "cursor_ordinal", "content_hash").join(moved.select("logical_id"), "logical_id", "left_anti")
        moved.unionByName(kept).write.mode("overwrite").parquet(self._path("plans", batch, "offsets"))
        self._mark("plans", batch)

    def run(self, lines: DataFrame, initial_offsets: DataFrame | None = None, fail_after: str | None = None) -> int:
        """One sync; returns its batch number. ``fail_after`` ('plan' or 'sink') stops there, for tests."""
        commits, plans = self._marked("commits"), self._marked("plans")
        batch = (commits[-1] if commits else 0) + 1
        if batch not in plans:
            first = initial_offsets if initial_offsets is not None else self.spark.createDataFrame([], OFFSETS)
            self._plan(batch, lines, self.offsets(commits[-1]) if commits else first)
        if fail_after == "plan":
            raise RuntimeError("stopped after the plan was written")
        self.spark.read.parquet(self._path("plans", batch, "rows")).write.mode("overwrite").parquet(self._path("sink", batch))
        if fail_after == "sink":
            raise RuntimeError("stopped before the commit")
        self._mark("commits", batch)
        return batch

    def batch(self, number: int) -> DataFrame:
        """The rows that one committed batch brought, one for each (log, generation, ordinal)."""
        rows = self.spark.read.parquet(self._path("sink", number))
        first = rows.groupBy("logical_id", "generation", "record_ordinal").agg(F.min("record_id").alias("record_id")).select("record_id")
        return rows.join(first, "record_id", "left_semi")

    def sink(self) -> DataFrame:
        """What a reader of the sink sees: the current generation of each log, one row per ordinal (the earliest batch's)."""
        done = self._marked("commits")
        rows = self.spark.read.parquet(*[self._path("sink", b) for b in done])
        now = self.offsets(done[-1]).select("logical_id", "generation")
        keep = rows.join(now, ["logical_id", "generation"], "left_semi")
        first = keep.groupBy("logical_id", "record_ordinal").agg(F.min(F.struct("batch", "record_id")).alias("s")).select("logical_id", "record_ordinal", "s.batch", "s.record_id")
        return keep.join(first, ["logical_id", "record_ordinal", "batch", "record_id"], "left_semi")


def new_rows(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows that a sync from the offsets of ``sources`` brings into an empty sink: plan, sink and commit in the shared folder."""
    sync = IncrementalSync(lines.sparkSession, scratch(lines.sparkSession, "sync"))
    return sync.batch(sync.run(lines, source_offsets(sources)))
