"""A stream over growing JSONL logs, and the idempotent ingest that it feeds.

The reader is a Python data source. Its offset is a map from file to (bytes, lines, guard): only complete lines are handed out, an incomplete
last line waits for the next batch. A file that shrank or whose guard (a hash of sampled windows of what was read) changed is read
again from the start under a higher generation. Reading is planned per file, so files are read in parallel on the executors.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

WINDOW, SAMPLES = 16 << 10, 5
SCHEMA = "path string, generation int, record_ordinal long, byte_offset long, line string"


def guard(path: str, size: int) -> str:
    """Hash of the size and up to five 16 KiB windows of the first ``size`` bytes."""
    h = hashlib.sha256(str(size).encode())
    with open(path, "rb") as f:
        for k in range(SAMPLES):
            f.seek(max(0, min(size * k // (SAMPLES - 1), size - WINDOW)))
            h.update(f.read(min(WINDOW, size - f.tell())))
    return h.hexdigest()


def complete_prefix(path: str, start: int) -> tuple[int, int]:
    """(end, lines) of the complete lines behind byte ``start``."""
    end, lines, at = start, 0, start
    with open(path, "rb") as f:
        f.seek(start)
        while block := f.read(1 << 20):
            lines += block.count(b"\n")
            last = block.rfind(b"\n")
            if last >= 0:
                end = at + last + 1
            at += len(block)
    return end, lines


class FilePart(InputPartition):
    def __init__(self, path: str, generation: int, start: int, end: int, ordinal: int):
        self.path, self.generation, self.start, self.end, self.ordinal = path, generation, start, end, ordinal


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern = pattern
        self.known: dict = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        out = {}
        for path in sorted(glob.glob(self.pattern, recursive=True)):
            was = self.known.get(path)
            size = os.path.getsize(path)
            same = was and size >= was["end"] and guard(path, was["end"]) == was["guard"]
            start, lines, generation = (was["end"], was["lines"], was["generation"]) if same else (0, 0, was["generation"] + 1 if was else 0)
            end, more = complete_prefix(path, start)
            out[path] = {"end": end, "lines": lines + more, "generation": generation, "guard": guard(path, end)}
        for path, was in self.known.items():
            out.setdefault(path, was)  # a log that is gone keeps its place
        self.known = out
        return {"files": json.dumps(out, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        a, b = json.loads(start["files"]), json.loads(end["files"])
        self.known = self.known or b
        parts = []
        for path, now in b.items():
            was = a.get(path)
            fresh = not was or was["generation"] != now["generation"]
            at, ordinal = (0, 0) if fresh else (was["end"], was["lines"])
            if now["end"] > at:
                parts.append(FilePart(path, now["generation"], at, now["end"], ordinal))
        return parts

    def read(self, partition: FilePart):
        at, ordinal = partition.start, partition.ordinal
        with open(partition.path, "rb") as f:
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                ordinal += 1
                yield (partition.path, partition.generation, ordinal, at, line.rstrip(b"\r\n").decode("utf-8", "replace"))
                at += len(line)

    def commit(self, end: dict) -> None:
        self.known = json.loads(end["files"])


class JsonlTail(DataSource):
    """``spark.readStream.format("jsonl_tail").load("/logs/**/*.jsonl")``"""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])


def ingest(spark: SparkSession, pattern: str, sink: str, checkpoint: str) -> None:
    """Read what is new into ``sink`` and stop. A batch that is replayed overwrites its own folder, so nothing is added twice."""
    spark.dataSource.register(JsonlTail)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    q = spark.readStream.format("jsonl_tail").load(pattern).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def lines(spark: SparkSession, sink: str) -> DataFrame:
    """Lines of the sink: the last generation of each file, one row per ordinal."""
    rows = spark.read.schema(SCHEMA + ", batch long").option("basePath", sink).parquet(sink)
    last = rows.groupBy("path").agg(F.max("generation").alias("generation"))
    return rows.join(last, ["path", "generation"]).groupBy("path", "record_ordinal").agg(F.min_by(F.struct("byte_offset", "line"), "batch").alias("s")).select("path", "record_ordinal", "s.byte_offset", "s.line")
