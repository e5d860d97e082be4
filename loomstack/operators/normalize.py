"""Normalisation of transcript records: redaction, noise, kinds, bounds.

Patterns are written for Java's engine but mean what they mean in RE2: word boundaries and white space are those of ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_W, _S = "0-9A-Za-z_", r"\t\n\f\r "
START, EDGE = f"(?<![{_W}])", f"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"
# What counts as a secret, a correction, a test command, an exit code.
_NAMES = "[A-Z0-9_]*(?:TOKEN|KEY|SECRET|PASSWORD|PASSWD)"
ASSIGNMENT = rf"""(?i)((?:"{_NAMES}"|'{_NAMES}'|{START}{_NAMES})[{_S}]*[:=][{_S}]*)("[^"]*"|'[^']*'|[^{_S},;}}\]]+)"""
BEARER = rf"""(?i)((?:"authorization"|'authorization'|{START}authorization)[{_S}]*[:=][{_S}]*["']?[{_S}]*bearer[{_S}]+)[A-Za-z0-9._~+/=-]{{8,}}"""
KNOWN = rf"{START}(?:sk-[A-Za-z0-9_-]{{12,}}|ghp_[A-Za-z0-9]{{12,}}|github_pat_[A-Za-z0-9_]{{12,}}|xox[baprs]-[A-Za-z0-9-]{{12,}}){EDGE}"
CORRECTION = rf"(?i)(?:{EDGE}(?:actually|instead|no,|correction){EDGE}|違(?:う|います)|ではなく|修正して|取り消して)"
TEST_COMMAND = (rf"(?i)(?:^|[;&|][{_S}]*|[{_S}])(?:go[{_S}]+test|pytest|cargo[{_S}]+test|npm[{_S}]+(?:run[{_S}]+)?test|pnpm[{_S}]+(?:run[{_S}]+)?test|yarn[{_S}]+test|make[{_S}]+test)(?:[{_S}]|$)")
EXIT_CODE = rf"(?i)(?:exit(?:ed)?(?:[{_S}]+with)?(?:[{_S}]+code)?[=: ]+)(-?[0-9]+)"
WRAPPERS = ("# Files pasted by the user:", "# Files attached by the user:", "## Referenced chats with Codex:")
REQUEST_MARK = "## My request:"
INJECTED = ("<recommended_plugins>", "# agents.md instructions", "<environment_context>", "<app-context>", "<skills_instructions>", "<permissions instructions>", "<collaboration_mode>",
            "<apps_instructions>", "<plugins_instructions>", "<subagent_notification>", "<team_message>", "<system-reminder>", "<turn_aborted>")
COMMAND_TOOLS = ("bash", "shell", "exec", "exec_command", "run_command")
FILE_TOOLS = ("edit", "write", "apply_patch", "create_file", "delete_file")
KIB = 1024
TEXT_LIMITS = {"message": 32 * KIB, "success": 4 * KIB, "unknown": 8 * KIB, "failure": 16 * KIB, "tool": 8 * KIB}
COMMAND_LIMIT, DIFF_LIMIT = 8 * KIB, 64 * KIB
MARKER = "\n…[truncated]…\n"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\x85\p{Z}]+|[\s\x85\p{Z}]+$", "")


def redact(c: Column) -> Column:
    """Secrets in assignments, bearer headers and of known shape become [REDACTED]."""
    c = F.regexp_replace(c, ASSIGNMENT, "$1[REDACTED]")
    c = F.regexp_replace(c, BEARER, "$1[REDACTED]")
    return F.regexp_replace(c, KNOWN, "[REDACTED]")


def looks_like_base64(c: Column) -> Column:
    """At least 512 bytes besides white space, 95 % of whose characters are of the base64 alphabets."""
    compact = F.regexp_replace(c, r"[\s\x85\p{Z}]+", "")
    n = F.length(compact)
    valid = F.length(F.regexp_replace(compact, "[^A-Za-z0-9+/=_-]+", ""))
    return F.coalesce((F.octet_length(compact) >= 512) & (F.floor(valid * 100 / F.greatest(n, F.lit(1))) >= 95), F.lit(False))


def observable(c: Column) -> Column:
    """What a user wrote: the request behind a file wrapper; nothing for injected context."""
    t = trimmed(c)
    wrapped = F.lit(False)
    for w in WRAPPERS:
        wrapped = wrapped | t.startswith(w)
    injected = F.lit(False)
    for p in INJECTED:
        injected = injected | F.lower(t).startswith(p)
    return F.when(wrapped & t.contains(REQUEST_MARK), trimmed(F.substring_index(t, REQUEST_MARK, -1))).when(injected, "").otherwise(t)


def subagent_result(c: Column) -> Column:
    """The completed status inside a sub-agent's notification, else null."""
    t = trimmed(c)
    body = F.regexp_extract(t, r"(?s)^<subagent_notification>(.*)</subagent_notification>$", 1)
    done = trimmed(F.get_json_object(F.when(body != "", body), "$.status.completed"))
    return F.when(done != "", done)


def exit_code(c: Column) -> Column:
    return F.regexp_extract(c, EXIT_CODE, 1).try_cast("int")


def classified(role: Column, kind: Column, tool: Column, command: Column, diff: Column, text: Column, code: Column) -> Column:
    """The kind of a record; the first rule that applies decides."""
    tool = F.lower(F.coalesce(tool, F.lit("")))
    command, diff, kind = (F.coalesce(x, F.lit("")) for x in (command, diff, kind))
    failed = F.coalesce(code != 0, F.lit(False))
    return (
        F.when(kind == "status", kind)
        .when((diff != "") | tool.isin(*FILE_TOOLS), "file_operation")
        .when(tool.isin(*COMMAND_TOOLS) | (command != ""), F.when(F.concat(F.lit(" "), command).rlike(TEST_COMMAND), "test").otherwise("command"))
        .when((role == "tool") & failed, F.when(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))).rlike(TEST_COMMAND), "test_failure").otherwise("error"))
        .when((role == "user") & F.coalesce(text.rlike(CORRECTION), F.lit(False)), "user_correction")
        .when((role == "tool") & kind.isin("", "message"), "command_output")
        .when(kind == "", "message").otherwise(kind))


def text_limit(role: Column, kind: Column, code: Column) -> Column:
    failed = F.coalesce(code != 0, F.lit(False))
    return (
        F.when(kind.isin("error", "test_failure") | failed, TEXT_LIMITS["failure"])
        .when((kind == "command_output") & F.coalesce(code == 0, F.lit(False)), TEXT_LIMITS["success"])
        .when((kind == "command_output") | (role == "tool"), TEXT_LIMITS["unknown"])
        .when(kind.isin("tool", "file_operation"), TEXT_LIMITS["tool"]).otherwise(TEXT_LIMITS["message"]))


def bounded(c: Column, limit: Column) -> Column:
    """Struct (text, truncated, original_bytes, sha256): head and tail around a marker, both ending at characters, if over ``limit`` bytes."""
    raw = F.encode(c, "UTF-8")
    n = F.octet_length(c)
    budget = limit - len(MARKER.encode())
    head = F.floor(budget / 2).cast("int")
    tail = (budget - head).cast("int")

    # A cut inside a character leaves replacement characters at the cut, and none elsewhere in valid text.
    front = F.regexp_replace(F.make_valid_utf8(F.substring(raw, F.lit(1), head).cast("string")), "�+$", "")
    back = F.regexp_replace(F.make_valid_utf8(F.substring(raw, n - tail + 1, tail).cast("string")), "^�+", "")
    over = n > limit
    return F.struct(
        F.when(over, F.concat(front, F.lit(MARKER), back)).otherwise(c).alias("text"), F.coalesce(over, F.lit(False)).alias("truncated"),
        F.coalesce(n, F.lit(0)).alias("original_bytes"), F.when(over, F.sha2(c, 256)).otherwise(F.lit("")).alias("sha256"))


def normal_paths(paths: Column, cwd: Column) -> Column:
    """Forward slashes, relative to ``cwd`` where inside, distinct and sorted."""
    c = F.regexp_replace(F.coalesce(cwd, F.lit("")), "/+$", "")
    clean = F.transform(paths, lambda p: F.trim(F.translate(p, "\\", "/")))
    inside = F.transform(clean, lambda p: F.when((c != "") & p.startswith(F.concat(c, F.lit("/"))), F.substr(p, F.length(c) + 2)).when((c != "") & (p == c), ".").otherwise(p))
    return F.array_sort(F.array_distinct(F.filter(inside, lambda p: p != "")))


def normalized(records: DataFrame) -> DataFrame:
    """Apply the whole pipeline to (role, kind, tool_name, text, command, diff, paths, cwd, exit_code, ...)."""
    clean = lambda n: redact(trimmed(F.translate(F.coalesce(F.col(n), F.lit("")), "\x00", "")))
    r = records.withColumns({n: clean(n) for n in ("text", "command", "diff")})
    sub = subagent_result(F.col("text"))
    r = r.withColumn("_sub", F.when(F.col("role") == "user", sub))
    r = r.withColumns({
        "kind": F.when(F.col("_sub").isNotNull(), "message").otherwise(F.col("kind")),
        "text": F.coalesce("_sub", F.when(F.col("role") == "user", observable(F.col("text"))).otherwise(F.col("text"))),
        "role": F.when(F.col("_sub").isNotNull(), "assistant").otherwise(F.col("role"))}).drop("_sub")
    r = r.withColumn("text", F.when(looks_like_base64(F.col("text")), "").otherwise(F.col("text")))
    r = r.withColumn("paths", normal_paths(F.coalesce("paths", F.array().cast("array<string>")), F.col("cwd")))
    r = r.withColumn("kind", classified(*(F.col(n) for n in ("role", "kind", "tool_name", "command", "diff", "text", "exit_code"))))
    r = r.withColumns({
        "_t": bounded(F.col("text"), text_limit(F.col("role"), F.col("kind"), F.col("exit_code"))), "_c": bounded(F.col("command"), F.lit(COMMAND_LIMIT)), "_d": bounded(F.col("diff"), F.lit(DIFF_LIMIT))})
    out = {}
    for n, s in (("text", "_t"), ("command", "_c"), ("diff", "_d")):
        out |= {n: F.col(f"{s}.text"), f"{n}_truncated": F.col(f"{s}.truncated"), f"{n}_original_bytes": F.col(f"{s}.original_bytes"), f"{n}_sha256": F.col(f"{s}.sha256")}
    return r.withColumns(out).drop("_t", "_c", "_d")


def retained(kind: Column, text: Column, command: Column, paths: Column) -> Column:
    """Records worth keeping: with a text, command or path, or a status."""
    return (kind == "status") | (text != "") | (command != "") | (F.size(paths) > 0)


def content_hash(role: Column, kind: Column, text: Column, text_sha: Column, command: Column, command_sha: Column, diff: Column, diff_sha: Column, paths: Column) -> Column:
    """Identity of a payload: SHA-256 over nine fields, each ended by a zero byte."""
    joined = F.array_join(F.array_sort(paths), "\n")
    return F.sha2(F.concat(*[F.concat(F.coalesce(c, F.lit("")), F.lit("\x00")) for c in (role, kind, text, text_sha, command, command_sha, diff, diff_sha, joined)]), 256)
