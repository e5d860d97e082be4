"""Source files: discovery, skip and ignore rules, text test, and a directory as a table."""

from __future__ import annotations

import os
import re
import stat
import subprocess

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOOL_DIR = ".loomstack"
MAX_FILE_BYTES = 1 << 20
PRUNED = (".git", TOOL_DIR, "node_modules", "vendor")


def skipped(path: Column) -> Column:
    """Paths never indexed: inside .git or the tool's folder, and side files of other tools."""
    return path.rlike(rf"(?:^|/)(?:\.git|{re.escape(TOOL_DIR)})(?:/|$)|\.uid$|\.import$")


def is_text(content: Column) -> Column:
    """Valid UTF-8 without zero bytes, with under 5 % control characters among its first 8,000 bytes."""
    head = F.substring(content, 1, 8000)
    latin = F.decode(head, "ISO-8859-1")
    control = F.length(F.regexp_replace(latin, r"[^\x01-\x08\x0e-\x1a\x1c-\x1f]", ""))
    return F.is_valid_utf8(content.cast("string")) & (F.instr(latin, "\x00") == 0) & (F.floor(control * 100 / F.greatest(F.length(latin), F.lit(1))) < 5)


class IgnoreRules:
    """An ignore file: the last rule that matches a path decides, '!' turns it around."""

    def __init__(self, text: str):
        self.rules: list[tuple[str, bool]] = []
        for line in text.splitlines():
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            pattern = line[1:] if negated else line
            if pattern.strip("/"):
                self.rules.append((self.regex(pattern), negated))

    @staticmethod
    def regex(pattern: str) -> str:
        """A rule as a regular expression over relative paths."""
        folder, rooted = pattern.endswith("/"), pattern.startswith("/")
        body = pattern.strip("/")
        if body.endswith("/**"):
            body, folder = body[:-3], True
        out, i = "", 0
        while i < len(body):
            if body[i:i + 3] == "**/":
                out, i = out + "(?:.*/)?", i + 3
            elif body[i:i + 2] == "**":
                out, i = out + ".*", i + 2
            elif body[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif body[i] == "?":
                out, i = out + "[^/]", i + 1
            else:
                out, i = out + re.escape(body[i]), i + 1
        start = "^" if rooted or "/" in body else "(?:^|/)"
        return f"{start}{out}{'/' if folder else '(?:/|$)'}"

    def match(self, path: str) -> bool:
        hit = False
        for rx, negated in self.rules:
            if re.search(rx, path):
                hit = not negated
        return hit

    def ignored(self, path: Column) -> Column:
        """The rules as one Column, folded in order."""
        out = F.lit(False)
        for rx, negated in self.rules:
            out = F.when(path.rlike(rx), F.lit(not negated)).otherwise(out)
        return out


def load_ignore(root: str, name: str = ".loomstackignore") -> IgnoreRules:
    at = os.path.join(root, name)
    return IgnoreRules(open(at, encoding="utf-8").read() if os.path.isfile(at) else "")


def tracked(root: str) -> list[str]:
    """Relative paths: what git lists, else a walk that skips PRUNED folders and links."""
    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "-z", "-co", "--exclude-standard"], capture_output=True, check=True, timeout=60).stdout
        return sorted({p for p in out.decode("utf-8", "replace").split("\0") if p})
    except (OSError, subprocess.SubprocessError):
        found = []
        for folder, dirs, names in os.walk(root):
            dirs[:] = sorted(d for d in dirs if d not in PRUNED and not os.path.islink(os.path.join(folder, d)))
            found += [os.path.relpath(os.path.join(folder, n), root) for n in names if not os.path.islink(os.path.join(folder, n))]
        return sorted(found)


def filtered(files: DataFrame, rules: IgnoreRules | None = None) -> DataFrame:
    """Files (path, size, ...) by name and size, before any content is read."""
    f = files.where(~skipped(F.col("path")) & (F.col("size") > 0) & (F.col("size") <= MAX_FILE_BYTES))
    return f.where(~rules.ignored(F.col("path"))) if rules and rules.rules else f


def _contents(root: str):
    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for path in batch.column("path").slice(at, 64).to_pylist():
                    full = os.path.join(root, path)
                    try:
                        st = os.lstat(full)
                        if stat.S_ISREG(st.st_mode) and 0 < st.st_size <= MAX_FILE_BYTES:
                            with open(full, "rb") as f:
                                rows.append((path, st.st_mtime_ns, st.st_size, f.read()))
                    except OSError:
                        continue  # gone, or not ours to read
                cols = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["path", "mtime", "size", "content"])

    return scan


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size, content, content_hash) of the text files under ``root``.

    Names are listed once and filtered; executors open just those files, so nothing below pruned folders is ever looked at.
    """
    root = os.path.abspath(root)
    rules = load_ignore(root)
    names = spark.createDataFrame([(p,) for p in tracked(root)], "path string").where(~skipped(F.col("path")))
    names = names.where(~rules.ignored(F.col("path"))) if rules.rules else names
    raw = names.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(_contents(root), "path string, mtime long, size long, content binary").where(is_text(F.col("content")))
    return raw.select("path", "mtime", "size", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("content_hash"))
