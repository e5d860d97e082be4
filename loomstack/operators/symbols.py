"""Definition symbols of source files.

Python is parsed with the standard library; the other languages are read with one expression per kind of definition, which covers
the same kinds but not every layout that a full grammar would (the end of a definition is found by indentation or braces).
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SIGNATURE_LINES, SIGNATURE_CHARS = 3, 400
# File endings by language.
EXTENSIONS = {".go": "go", ".py": "python", ".gd": "gdscript", ".rb": "ruby", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
              ".ts": "typescript", ".tsx": "tsx", ".mts": "typescript", ".cts": "typescript"}
LANGUAGES = ("go", "python", "gdscript", "ruby", "javascript", "typescript", "tsx")
_ID = r"[A-Za-z_$][\w$]*"
_JS = [
    ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({_ID})"),
    ("class", rf"=\s*class\s+({_ID})"),
    ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({_ID})"),
    ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+({_ID})\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|{_ID}\s*=>)"),
    ("method", rf"^\s+(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?({_ID})\s*\([^)]*\)\s*(?::\s*[^{{;]+)?\{{"),
]
_TS = _JS + [
    ("interface", rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+({_ID})"),
    ("type", rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+({_ID})\s*(?:<[^=]*>)?\s*="),
    ("method", rf"^\s+(?:(?:public|private|protected|abstract)\s+)*({_ID})\??\s*\([^)]*\)\s*:\s*[^{{;]+;\s*$"),
]
PATTERNS = {
    "go": [("function", rf"^func\s+({_ID})\s*[\[(]"), ("method", rf"^func\s+\([^)]*\)\s*({_ID})\s*[\[(]"), ("type", rf"^(?:type\s+|\t)({_ID})(?:\[[^\]]*\])?\s+(?:struct|interface)\b"),
           ("type", rf"^type\s+({_ID})(?:\[[^\]]*\])?\s+(?!struct\b|interface\b)=?\s*[\w*\[(]")],
    "gdscript": [("class", rf"^\s*class_name\s+({_ID})"), ("class", rf"^\s*class\s+({_ID})"), ("function", rf"^\s*(?:static\s+)?func\s+({_ID})"),
                 ("signal", rf"^\s*signal\s+({_ID})"), ("constant", rf"^\s*const\s+({_ID})")],
    "ruby": [("class", r"^\s*class\s+(?:<<\s*)?((?:\w+::)*[A-Z]\w*)"), ("module", r"^\s*module\s+((?:\w+::)*[A-Z]\w*)"),
             ("method", r"^\s*def\s+(?:(?:self|[A-Z]\w*)\.)?([A-Za-z_]\w*[?!=]?|[+\-*/<>=!~%&|^\[\]]+)")],
    "javascript": _JS, "typescript": _TS, "tsx": _TS,
}
COMPILED = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in PATTERNS.items()}
_NOT_METHODS = frozenset("if for while switch catch return function with do else await typeof new".split())


def enabled(names: list[str] | None) -> frozenset[str]:
    """Languages switched on: all for None, none for an empty list; 'typescript' brings 'tsx' along."""
    if names is None:
        return frozenset(LANGUAGES)
    out = [n.strip().lower() for n in names]
    for n in out:
        if not n or n not in LANGUAGES:
            raise ValueError(f"unknown language {n!r}")
    if len(set(out)) < len(out):
        raise ValueError("a language is named twice")
    return frozenset(out) | ({"tsx"} if "typescript" in out else set())


def language_of(path: str, on: frozenset[str] | None = None) -> str | None:
    ext = re.search(r"\.[^./\\]*$", path or "")
    lang = EXTENSIONS.get(ext.group().lower()) if ext else None
    return lang if lang and (on is None or lang in on) else None


def fingerprint(on: frozenset[str]) -> str:
    """Changes whenever a pattern or the set of languages does, so that an index knows to rebuild."""
    text = "\n".join(f"{k}\t{kind}\t{p}" for k in sorted(on) for kind, p in PATTERNS.get(k, [("ast", "python")]))
    return hashlib.sha256(text.encode()).hexdigest()


def signature(lines: list[str], start_line: int) -> str:
    """Up to three lines from a definition on, within 400 characters."""
    return "\n".join(lines[max(start_line, 1) - 1:][:SIGNATURE_LINES]).rstrip("\r")[:SIGNATURE_CHARS]


def _end(lines: list[str], start: int, lang: str) -> int:
    """Last line of the definition that starts on line ``start``."""
    head = lines[start - 1]
    if lang in ("go", "javascript", "typescript", "tsx"):
        depth, opened = 0, False
        for i in range(start - 1, len(lines)):
            for c in lines[i]:
                if c == "{":
                    depth, opened = depth + 1, True
                elif c == "}":
                    depth -= 1
            if opened and depth <= 0:
                return i + 1
            if not opened and i > start:
                return start
        return len(lines)
    indent = len(head) - len(head.lstrip())
    if lang == "ruby":
        return next((i + 1 for i in range(start, len(lines)) if lines[i].strip() == "end" and len(lines[i]) - len(lines[i].lstrip()) == indent), start)
    if lang == "gdscript" and not head.rstrip().endswith(":"):
        return start
    last = start
    for i in range(start, len(lines)):
        if lines[i].strip():
            if len(lines[i]) - len(lines[i].lstrip()) <= indent:
                break
            last = i + 1
    return last


def extract(path: str, text: str | None, on: frozenset[str] | None = None) -> list[tuple[str, str, int, int, str]]:
    """(name, kind, start_line, end_line, signature) of each definition, in file order."""
    lang = language_of(path, on)
    if not lang or not text:
        return []
    lines = text.split("\n")
    found: list[tuple[str, str, int, int]] = []
    if lang == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            for m in re.finditer(rf"^\s*(?:async\s+)?(def|class)\s+({_ID})", text, re.M):
                start = text.count("\n", 0, m.start(1)) + 1
                found.append((m.group(2), "class" if m.group(1) == "class" else "function", start, _end(lines, start, lang)))
        else:
            for node in ast.walk(tree):
                if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                    found.append((node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, max(node.end_lineno, node.lineno)))
    else:
        for kind, rx in COMPILED[lang]:
            for m in rx.finditer(text):
                name = m.group(1).rpartition("::")[2]
                if kind == "method" and name in _NOT_METHODS:
                    continue
                start = text.count("\n", 0, m.start(1)) + 1
                found.append((name, kind, start, max(_end(lines, start, lang), start)))
    return [(n, k, a, b, signature(lines, a)) for n, k, a, b in sorted(set(found), key=lambda s: (s[2], s[0], s[1]))]


SCHEMA = "file_id long, path string, name string, kind string, start_line int, end_line int, raw_signature string"


def symbols(files: DataFrame, on: frozenset[str] | None = None) -> DataFrame:
    """Symbols of ``files`` (file_id, path, content); content starts at line ``first_line`` where that column exists."""
    names = ["file_id", "path", "content"] + (["first_line"] if "first_line" in files.columns else [])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
        fields = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for rec in zip(*(batch.column(n).to_pylist() for n in names)):
                shift = (rec[3] or 1) - 1 if len(rec) > 3 else 0
                rows += [(rec[0], rec[1], n, k, a + shift, b + shift, s) for n, k, a, b, s in extract(rec[1] or "", rec[2], on)]
            cols = list(zip(*rows)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], fields)

    return files.select(*names).mapInArrow(scan, SCHEMA)
