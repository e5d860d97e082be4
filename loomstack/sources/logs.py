"""Agent logs: one JSON line becomes any number of records.

The four line formats differ in where they keep things, so a format is a small description and the block handling is shared. Unknown
fields are never read, reasoning is dropped. Lines are decoded in Arrow batches; only the recursive walk of tool inputs needs Python.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGENTS = ("codex", "claude", "opencode", "cursor", "pi")
# What the formats call things.
ROLES = {"user": "user", "assistant": "assistant", "tool": "tool", "toolresult": "tool", "tool_result": "tool", "system": "system"}
REASONING = frozenset(("thinking", "reasoning", "redacted_thinking", "encrypted_reasoning", "agent_reasoning"))
TEXT_BLOCKS = frozenset(("text", "input_text", "output_text"))
COMMAND_KEYS, PATH_KEYS, DIFF_KEYS = frozenset(("cmd", "command", "script")), frozenset(("path", "file_path", "file", "target_file")), frozenset(("patch", "diff"))
PATCH_HEADS = ("*** Add File: ", "*** Update File: ", "*** Delete File: ", "*** Move to: ")
JS_STRING = r'("(?:\\.|[^"\\])*")'
JS_ASSIGNMENT = re.compile(r"\b(?:const|let|var)\s+[A-Za-z_$][A-Za-z0-9_$]*\s*=\s*" + JS_STRING, re.S)
JS_COMMAND = re.compile(r"""(?:\bcmd|["']cmd["'])\s*:\s*""" + JS_STRING, re.S)
EXIT_CODE = re.compile(r"(?:exit(?:ed)?(?:\s+with)?(?:\s+code)?[=: ]+)(-?\d+)", re.I)
MAX_LINE = 8 << 20


def is_patch(text: str) -> bool:
    return any(m in text for m in ("*** Begin Patch", "*** Update File:", "diff --git ")) or ("\n--- " in text and "\n+++ " in text)


def patch_paths(diff: str) -> list[str]:
    out = []
    for line in map(str.strip, diff.split("\n")):
        out += [line[len(h):].strip() for h in PATCH_HEADS if line.startswith(h)]
        if line.startswith("diff --git a/") and len(line.split()) >= 4:
            out.append(line.split()[3].removeprefix("b/"))
        elif line.startswith("+++ b/"):
            out.append(line[6:])
    return out


def _unquoted(literal: str) -> str | None:
    try:
        return ast.literal_eval(literal)
    except (SyntaxError, ValueError):
        return None


@dataclass
class ToolInput:
    """First command, paths and diffs found anywhere inside the argument of a tool call, keys in sorted order."""

    command: str = ""
    paths: list[str] = field(default_factory=list)
    diffs: list[str] = field(default_factory=list)

    def walk(self, value, commanded: bool = False) -> "ToolInput":
        if isinstance(value, dict):
            for key in sorted(value):
                low, child = key.lower(), value[key]
                if low in PATH_KEYS:
                    self.paths += self._strings(child)
                elif low in DIFF_KEYS:
                    self.diffs += [child] if isinstance(child, str) and is_patch(child) else []
                else:
                    self.walk(child, low in COMMAND_KEYS)
        elif isinstance(value, list):
            for child in value:
                self.walk(child, commanded)
        elif isinstance(value, str) and value.strip():
            self._text(value.strip(), commanded)
        return self

    def _strings(self, value) -> list[str]:
        return [value] if isinstance(value, str) else [s for v in value for s in self._strings(v)] if isinstance(value, list) else []

    def _text(self, text: str, commanded: bool) -> None:
        if text[0] in "{[":
            try:
                self.walk(json.loads(text), commanded)
                return
            except ValueError:
                pass
        if "tools.apply_patch(" in text:
            patch = next((p for p in map(_unquoted, JS_ASSIGNMENT.findall(text)) if p and is_patch(p)), None)
            if patch:
                self.diffs.append(patch)
                return
        if "tools.exec_command(" in text and not self.command:
            m = JS_COMMAND.search(text)
            inner = _unquoted(m.group(1)) if m else None
            if inner and inner.strip():
                self.command = inner.strip()
                return
        if is_patch(text):
            self.diffs.append(text)
        elif not self.command and (commanded or not re.search(r"[\r\n]", text)):
            self.command = text

    def record(self, raw) -> dict:
        diff = "\n".join(self.diffs).strip()
        paths = sorted({p for p in (x.replace("\\", "/").strip() for x in self.paths + patch_paths("\n".join(self.diffs))) if p})
        return {"command": self.command, "diff": diff, "paths": paths, "text": "" if self.command or diff else compact(raw)}


def _plain_numbers(value):
    """Numbers as a decoder that knows only doubles writes them again: whole ones without a fraction."""
    if isinstance(value, dict):
        return {k: _plain_numbers(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain_numbers(v) for v in value]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        value = float(value)
        return int(value) if value.is_integer() and abs(value) < 1e21 else value
    return value


def compact(value) -> str:
    """JSON with sorted keys, doubles for numbers and the web-safe escapes of the reference's encoder."""
    if value is None:
        return ""
    text = json.dumps(_plain_numbers(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for raw, safe in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        text = text.replace(raw, safe)
    return text


def tool_call(raw) -> dict:
    return ToolInput().walk(raw).record(raw) if raw is not None else {"command": "", "diff": "", "paths": [], "text": ""}


def plain_text(value) -> str:
    """A string, or the text blocks of a list joined by line ends."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(b.get("text") or "" for b in value if isinstance(b, dict) and b.get("type") in TEXT_BLOCKS)
    return ""


def exit_code(text: str) -> int | None:
    m = EXIT_CODE.search(text)
    return int(m.group(1)) if m else None


class Line:
    """Records and skip counts of one line."""

    def __init__(self) -> None:
        self.records: list[dict] = []
        self.noise = self.reasoning = self.unknown = 0

    def add(self, part: int = 0, **values) -> None:
        self.records.append({"part_ordinal": part, **values})


def _as_dict(value) -> dict:
    return value if isinstance(value, dict) else {}


def _blocks(out: Line, role: str, content, base: dict, *, ids: bool, results: bool) -> None:
    """Blocks of a message: texts, tool calls, tool results. ``ids``: a call's event id is the block's own; ``results``: blocks may be results."""
    for k, b in enumerate(content, 1):
        b = _as_dict(b)
        kind = str(b.get("type") or "").lower()
        if kind in REASONING:
            out.reasoning += 1
        elif kind == "text":
            out.add(k, **base, role=role, kind="command_output" if role == "tool" and ids else "message", text=b.get("text") or "")
        elif kind in ("tool_use", "toolcall", "tool_call"):
            raw = b["arguments"] if b.get("arguments") is not None else b.get("input")
            own = {"native_event_id": b.get("id") or ""} if ids else {}
            out.add(k, **(base | own | {"exit_code": None}), role="assistant" if ids else role, kind="tool", tool_name=b.get("name") or "", **(tool_call(raw) | {}), call=b.get("id") or "")
        elif kind == "tool_result" and results:
            text = plain_text(b.get("content"))
            out.add(k, **(base | {"exit_code": 1 if b.get("is_error") else exit_code(text)}), role="tool", kind="command_output", call=b.get("tool_use_id") or "", text=text)
        else:
            out.unknown += 1


def decode_codex(d: dict) -> Line:
    out, p = Line(), _as_dict(d.get("payload"))
    kind, sub = d.get("type"), p.get("type")
    base = {"timestamp": d.get("timestamp") or ""}
    if kind in ("session_meta", "turn_context", "world_state", "compacted"):
        out.noise += 1
    elif kind == "response_item":
        if sub in REASONING:
            out.reasoning += 1
        elif sub == "message" and ROLES.get(str(p.get("role")).lower()) in ("user", "assistant"):
            for k, b in enumerate(p.get("content") or [], 1):
                b = _as_dict(b)
                if b.get("type") in TEXT_BLOCKS:
                    out.add(k, **base, role=ROLES[p["role"].lower()], kind="message", text=b.get("text") or "")
                elif b.get("type") in REASONING:
                    out.reasoning += 1
                else:
                    out.unknown += 1
        elif sub in ("function_call", "custom_tool_call"):
            raw = p["input"] if p.get("input") is not None else p.get("arguments")
            out.add(**base, role="assistant", kind="tool", tool_name=p.get("name") or "", call=p.get("call_id") or "", **tool_call(raw))
        elif sub in ("function_call_output", "custom_tool_call_output"):
            text = plain_text(p.get("output"))
            out.add(**base, role="tool", kind="command_output", call=p.get("call_id") or "", text=text, exit_code=exit_code(text))
        elif sub == "web_search_call":
            out.noise += 1
        else:
            out.unknown += 1
    elif kind == "event_msg":
        if sub == "agent_reasoning":
            out.reasoning += 1
        elif sub in ("user_message", "agent_message"):
            text = p.get("message") or p.get("text") or ""
            if text:
                out.add(**base, role="user" if sub == "user_message" else "assistant", kind="message", text=text)
        elif sub == "task_complete":
            out.add(**base, role="system", kind="status", text="complete")
        else:
            out.noise += 1
    else:
        out.unknown += 1
    return out


def decode_claude(d: dict) -> Line:
    out, m = Line(), _as_dict(d.get("message"))
    if d.get("type") not in ("user", "assistant"):
        out.noise += 1
        return out
    role = ROLES.get(str(m.get("role")).lower())
    if not role:
        out.unknown += 1
        return out
    base = {"timestamp": d.get("timestamp") or "", "native_event_id": d.get("uuid") or "", "parent_native_id": d.get("parentUuid") or "", "session": d.get("sessionId") or "", "cwd": d.get("cwd") or ""}
    if isinstance(m.get("content"), str):
        out.add(**base, role=role, kind="message", text=m["content"])
    else:
        _blocks(out, role, m.get("content") or [], base, ids=True, results=True)
    return out


def decode_cursor(d: dict) -> Line:
    out = Line()
    if d.get("type") == "turn_ended":
        out.add(role="system", kind="status", text=d.get("status") or "")
        return out
    role = ROLES.get(str(d.get("role")).lower())
    if not role:
        out.unknown += 1
        return out
    _blocks(out, role, _as_dict(d.get("message")).get("content") or [], {}, ids=False, results=False)
    return out


def decode_pi(d: dict) -> Line:
    out, m = Line(), _as_dict(d.get("message"))
    if d.get("type") != "message":
        known = d.get("type") in ("session", "thinking_level_change", "model_change", "session_info")
        out.noise, out.unknown = int(known), int(not known)
        return out
    role = ROLES.get(str(m.get("role")).lower())
    if not role:
        out.unknown += 1
        return out
    base = {"timestamp": d.get("timestamp") or "", "native_event_id": d.get("id") or "", "parent_native_id": d.get("parentId") or ""}
    if role == "tool":
        base |= {"call": m.get("toolCallId") or "", "exit_code": 1 if m.get("isError") else None}
    content = m.get("content")
    if isinstance(content, str):
        out.add(**base, role=role, kind="message", text=content)
        return out
    before = len(out.records)
    inner = Line()
    _blocks(inner, role, content or [], {k: v for k, v in base.items() if k != "call"}, ids=True, results=False)
    for r in inner.records:
        out.records.append({"call": base.get("call", "")} | r if r["kind"] != "tool" else r)
    out.reasoning, out.unknown = inner.reasoning, inner.unknown
    if role == "tool" and len(out.records) == before:
        out.add(**base, role=role, kind="command_output", text=plain_text(content))
    return out


DECODERS = {"codex": decode_codex, "claude": decode_claude, "cursor": decode_cursor, "pi": decode_pi}

RECORDS = ("logical_id string, record_ordinal long, part_ordinal long, byte_offset long, native_session_id string, native_event_id string, parent_native_id string, timestamp string, role string, kind string, "
           "tool_name string, call_id string, exit_code int, text string, command string, diff string, paths array<string>, cwd string, malformed boolean, noise int, reasoning int, unknown int")
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def decode_line(agent: str, line: str | None) -> tuple[Line, bool]:
    """(result, malformed). Blank and oversized lines are noise."""
    if not line or not line.strip() or len(line) * 4 > MAX_LINE and len(line.encode()) > MAX_LINE:
        out = Line()
        out.noise = 1
        return out, False
    try:
        d = json.loads(line)
        return DECODERS[agent](d if isinstance(d, dict) else {}), False
    except (ValueError, AttributeError, TypeError, KeyError):
        return Line(), True


def records(lines: DataFrame, agent: str) -> DataFrame:
    """Records of (logical_id, record_ordinal, byte_offset, line); a line without records still gives one row that carries its counts, with null role."""
    if agent not in DECODERS:
        raise ValueError(f"unknown agent {agent!r}")
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [_TYPES[f.split()[1]] for f in RECORDS.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for log, ordinal, at, line in zip(*(batch.column(n).to_pylist() for n in ("logical_id", "record_ordinal", "byte_offset", "line"))):
                out, bad = decode_line(agent, line)
                for k, r in enumerate(out.records or [{}]):
                    counts = (bad, out.noise, out.reasoning, out.unknown) if not k else (False, 0, 0, 0)
                    text = lambda n: r.get(n) or ""  # noqa: E731, B023
                    rows.append((log, ordinal, r.get("part_ordinal", 0), at, text("session") or log.partition("/")[2], text("native_event_id"), text("parent_native_id"), text("timestamp"), r.get("role"), r.get("kind"),
                                 text("tool_name"), text("call"), r.get("exit_code"), text("text"), text("command"), text("diff"), r.get("paths") or [], text("cwd"), *counts))
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return lines.select("logical_id", "record_ordinal", "byte_offset", "line").mapInArrow(scan, RECORDS)


def headers(lines: DataFrame) -> DataFrame:
    """(logical_id, native_session_id, parent, lineage, cwd, title, started): what the first 64 lines say about a session.

    Later lines win for id, directory and title; the first non-empty value for parent and lineage. Reading stops at the first line after
    which both id and directory are known.
    """
    j = lambda *paths: F.coalesce(*[F.when(F.trim(F.get_json_object("line", p)) != "", F.trim(F.get_json_object("line", p))) for p in paths])
    h = lines.where("record_ordinal <= 64").select(
        "logical_id", "record_ordinal",
        F.coalesce(F.when(j("$.type") == "session_meta", j("$.payload.session_id", "$.payload.id")), F.when(j("$.type") == "session", j("$.id")), j("$.sessionId")).alias("sid"),
        j("$.parentSessionId", "$.parent_id", "$.continuation_of", "$.forked_from", "$.payload.parent_session_id", "$.payload.parent_id", "$.payload.continuation_of", "$.payload.forked_from").alias("parent"),
        j("$.task_lineage_id", "$.payload.task_lineage_id").alias("lineage"), j("$.payload.cwd", "$.cwd").alias("cwd"), j("$.title").alias("title"), j("$.payload.timestamp", "$.timestamp").alias("ts"))
    known = h.groupBy("logical_id").agg(F.min(F.when(F.col("cwd").isNotNull(), F.col("record_ordinal"))).alias("upto"))
    h = h.join(known, "logical_id").where(F.col("upto").isNull() | (F.col("record_ordinal") <= F.col("upto")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("record_ordinal")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("record_ordinal")))
    return h.groupBy("logical_id").agg(
        F.coalesce(last("sid"), F.element_at(F.split(F.first("logical_id"), "/"), -1)).alias("native_session_id"), F.coalesce(first("parent"), F.lit("")).alias("parent"),
        F.coalesce(first("lineage"), F.lit("")).alias("lineage"), F.coalesce(last("cwd"), F.lit("")).alias("cwd"), F.coalesce(last("title"), F.lit("")).alias("title"), F.coalesce(last("ts"), F.lit("")).alias("started"))
