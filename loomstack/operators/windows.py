"""Files put together again from the line windows that they were cut into."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_END = re.compile("\r\n|\n|\r")


def window_lines(body: str | None, count: int) -> list[str]:
    """The lines of a window; an end behind the last of ``count`` lines opens no further one."""
    lines = _END.split(body or "")
    return lines[:-1] if len(lines) == count + 1 and not lines[-1] else lines


class _File:
    def __init__(self, file_id: int, path: str):
        self.file_id, self.path, self.lines, self.upto = file_id, path, [], 0

    def add(self, start: int, end: int, body: str | None) -> None:
        lines = window_lines(body, end - start + 1)
        self.lines += [""] * (start - 1 - self.upto)  # lines that no window holds
        self.lines += lines[max(self.upto + 1 - start, 0):]
        self.upto = len(self.lines)


def reassembled(chunks: DataFrame) -> DataFrame:
    """(file_id, path, content) from windows (file_id, path, start_line, end_line, raw_body); overlapping lines count once, gaps are blank lines.

    Files are bounded in size where they are read, and stream through a task one at a time, window by window in order; rows without a file or
    lines are left out, and a window that repeats adds nothing.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(files: list[_File]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f.file_id for f in files], pa.int64()), pa.array([f.path for f in files], pa.string()), pa.array(["\n".join(f.lines) for f in files], pa.string())], ["file_id", "path", "content"])

        at: _File | None = None
        for batch in batches:
            done = []
            for i, path, a, b, body in zip(*(batch.column(n).to_pylist() for n in ("file_id", "path", "start_line", "end_line", "raw_body"))):
                if at is None or i != at.file_id:
                    done += [at] if at else []
                    at = _File(i, path)
                at.add(a, b, body)
            yield out(done)
        if at:
            yield out([at])

    rows = chunks.select(F.col("file_id").cast("long").alias("file_id"), "path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "raw_body")
    return rows.where("file_id is not null and start_line >= 1 and end_line >= start_line").repartition("file_id").sortWithinPartitions("file_id", "start_line", "end_line").mapInArrow(scan, "file_id long, path string, content string")
