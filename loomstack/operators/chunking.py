"""Line-window chunks that prefer to break at blank lines.

A window's end and the next start depend on where the blank lines are, so windows are a recurrence within one file; files are independent.
Blank lines are indexed once per file and each step is two binary searches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LINES, OVERLAP = 80, 10
MAX_LINE_BYTES, MAX_CHUNK_BYTES = 16 << 10, 64 << 10


def file_lines(text: str, max_line: int = MAX_LINE_BYTES) -> list[bytes]:
    """Lines in any convention of line ends, without a last empty one, each cut at ``max_line`` bytes (a character may be cut)."""
    if not text:
        return []
    lines = text.replace("\r\n", "\n").replace("\r", "\n").encode().split(b"\n")
    if not lines[-1]:
        lines.pop()
    return [line[:max_line] for line in lines]


def windows(blank: list[int], n: int, size: int = LINES, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """(start, end) of each window over ``n`` lines, 0-based and end exclusive; ``blank`` holds the blank lines' numbers."""
    overlap = min(overlap, size - 1)
    start = 0
    while start < n:
        end = min(start + size, n)
        if start + size <= n:
            at = bisect_left(blank, end) - 1
            if at >= 0 and blank[at] >= max(start + size // 2, start + 1):
                end = blank[at] + 1
        yield start, end
        if end == n:
            return
        following = max(end - overlap, start + 1)
        at = bisect_left(blank, following - 1)
        near = blank[at] + 1 if at < len(blank) else n
        start = near if near < min(following + overlap, end) else following


def cut(body: bytes, limit: int) -> bytes:
    """At most ``limit`` bytes, ending between characters."""
    if len(body) <= limit:
        return body
    while limit and body[limit] & 0xC0 == 0x80:
        limit -= 1
    return body[:limit]


def split(text: str, size: int = LINES, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Chunks (start_line, end_line, body) of one file, 1-based and inclusive."""
    lines = file_lines(text)
    blank = [i for i, line in enumerate(lines) if not line.decode("utf-8", "replace").strip()]
    return [(a + 1, b, cut(b"\n".join(lines[a:b]), MAX_CHUNK_BYTES).decode("utf-8", "replace")) for a, b in windows(blank, len(lines), size, overlap)]


def chunks(files: DataFrame, key: str, content: str, size: int = LINES, overlap: int = OVERLAP) -> DataFrame:
    """(key, start_line, end_line, body) of every file; null and empty contents have none."""
    kind = dict(files.dtypes)[key]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [(i, *c) for i, t in enumerate(part.column(1).to_pylist()) for c in split(t or "", size, overlap)]
                which, start, end, body = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(which, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(body, pa.string())], [key, "start_line", "end_line", "body"])

    return files.select(key, content).mapInArrow(scan, f"{key} {kind}, start_line int, end_line int, body string")
