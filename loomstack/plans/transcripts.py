"""Queries of the transcript side: normalisation, event store, sessions, episodes, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.functions import text as T
from loomstack.operators import episodes as E
from loomstack.operators import evidence as V
from loomstack.operators import normalize as N
from loomstack.operators import sessions as S
from loomstack.operators.ranks import ranked
from loomstack.operators.timestamps import FROM_S, TO_S
from loomstack.plans.retrieval import sql_terms, sql_tokens
from loomstack.runtime import spread, table, written

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return register


# ---- SQL building blocks ----------------------------------------------------------------------------------------------------
_WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


_ORD = "ts, source_id, record_ordinal, part_ordinal, id"
_CLEAN = f"""clean as (select id, session_id, content_id, source_id, record_ordinal, part_ordinal, coalesce(native_event_id, '') as native_event_id, coalesce(parent_native_id, '') as parent_native_id,
  coalesce(call_id, '') as call_id, coalesce(kind, '') as kind, exit_code, case when r in ('toolresult', 'tool_result') then 'tool' else r end as role,
  case when ts >= {FROM_S} and ts < {TO_S} then ts * 1000 when ts >= {FROM_S}000 and ts < {TO_S}000 then ts when ts >= {FROM_S}000000 and ts < {TO_S}000000 then ts // 1000
    when ts >= {FROM_S}000000000 and ts < {TO_S}000000000 then ts // 1000000 else 0 end as ts
  from (select *, lower({_strip("coalesce(role, '')")}) as r from session_events))"""
_KEY = "case when call_id <> '' then 'call ' || call_id when native_event_id <> '' then 'native ' || native_event_id else 'time ' || ts || ' ' || parent_native_id end"
_DUP = f"{_CLEAN}, dup as (select *, case when f <> id then f end as duplicate_of from (select *, first_value(id) over (partition by session_id, content_id, {_KEY} order by {_ORD}) as f from clean))"
_FIX = r"0-9A-Za-z_"
# The patterns of ``normalize`` and ``episodes`` in the dialect of the SQL engine, with its own word boundaries.
_RX = {
    "assign": r"""(?i)((?:"[A-Z0-9_]*(?:TOKEN|KEY|SECRET|PASSWORD|PASSWD)"|''[A-Z0-9_]*(?:TOKEN|KEY|SECRET|PASSWORD|PASSWD)''|\b[A-Z0-9_]*(?:TOKEN|KEY|SECRET|PASSWORD|PASSWD))\s*[:=]\s*)("[^"]*"|''[^'']*''|[^\s,;}\]]+)""",
    "bearer": r"""(?i)((?:"authorization"|''authorization''|\bauthorization)\s*[:=]\s*["'']?\s*bearer\s+)[A-Za-z0-9._~+/=-]{8,}""",
    "known": r"\b(?:sk-[A-Za-z0-9_-]{12,}|ghp_[A-Za-z0-9]{12,}|github_pat_[A-Za-z0-9_]{12,}|xox[baprs]-[A-Za-z0-9-]{12,})\b",
    "correction": r"(?i)(?:\b(?:actually|instead|no,|correction)\b|違(?:う|います)|ではなく|修正して|取り消して)",
    "test": r"(?i)(?:^|[;&|]\s*|\s)(?:go\s+test|pytest|cargo\s+test|npm\s+(?:run\s+)?test|pnpm\s+(?:run\s+)?test|yarn\s+test|make\s+test)(?:\s|$)",
    "exit": r"(?i)(?:exit(?:ed)?(?:\s+with)?(?:\s+code)?[=: ]+)(-?\d+)",
    "scope": r"(?i)(?:\bscope\b|\bscoped\b|\bonly\b|\bin scope\b|範囲|対象|含めない|除外)",
    "design": r"(?i)(?:\bdesign\b|\barchitecture\b|\bpolicy\b|\buse [a-z0-9_./-]+\b|方針|設計|規約|契約|〜にする|にする)",
}


def _sql_redact(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({c}, '{_RX['assign']}', '\1[REDACTED]', 'g'), '{_RX['bearer']}', '\1[REDACTED]', 'g'), '{_RX['known']}', '[REDACTED]', 'g')"




def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean events with duplicates marked, as a written table."""
    return S.materialized(table(spark, sf_dir, "session_events", "id", "session_id", "content_id", "source_id", "record_ordinal", "part_ordinal", "native_event_id", "parent_native_id", "ts", "role", "kind", "call_id", "exit_code"))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "event_contents", "id", "text", "command", "diff")


# ---- normalisation ----------------------------------------------------------------------------------------------------------
@query(f"select id, sha256({_sql_redact('text')}) as text_sha, sha256({_sql_redact('command')}) as command_sha, coalesce(({_sql_redact('text')}) <> text, false) as changed from event_contents")
def redact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _contents(spark, sf_dir)
    return c.select("id", F.sha2(N.redact(F.col("text")), 256).alias("text_sha"), F.sha2(N.redact(F.col("command")), 256).alias("command_sha"), F.coalesce(N.redact(F.col("text")) != F.col("text"), F.lit(False)).alias("changed"))


@query(f"select id, path, sha256({_sql_redact('raw_body')}) as body_sha, ({_sql_redact('raw_body')}) <> raw_body as changed from chunks")
def redact_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks", "id", "path", "raw_body")
    return c.select("id", "path", F.sha2(N.redact(F.col("raw_body")), 256).alias("body_sha"), (N.redact(F.col("raw_body")) != F.col("raw_body")).alias("changed"))


_COMPACT = r"regexp_replace(text, '[\s\v\x1c-\x1f\x{85}\p{Z}]+', '', 'g')"


@query(f"select doc_id, coalesce(strlen({_COMPACT}) >= 512 and length(regexp_replace({_COMPACT}, '[^A-Za-z0-9+/=_-]+', '', 'g')) * 100 // greatest(length({_COMPACT}), 1) >= 95, false) as noise from documents")
def base64_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", N.looks_like_base64(F.col("text")).alias("noise"))


@query("select doc_id, coalesce(strlen(text) > 4096, false) as truncated, coalesce(strlen(text), 0)::int as original_bytes, case when strlen(text) > 4096 then sha256(text) else '' end as digest, coalesce(least(strlen(text), 4096) >= 0, true) as fits from documents")
def bound_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding to 4 KiB: flag, original size, digest, and that the result fits."""
    b = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("b", N.bounded(F.col("text"), F.lit(4096)))
    return b.select("doc_id", "b.truncated", "b.original_bytes", F.coalesce("b.sha256", F.lit("")).alias("digest"), F.coalesce(F.octet_length("b.text") <= 4096, F.lit(True)).alias("fits"))


_KIND = f"""case when kind0 = 'status' then kind0 when diff <> '' or tool in {N.FILE_TOOLS} then 'file_operation'
  when tool in {N.COMMAND_TOOLS} or command <> '' then case when regexp_matches(' ' || command, '{_RX['test']}') then 'test' else 'command' end
  when role = 'tool' and coalesce(exit_code <> 0, false) then case when regexp_matches(' ' || text, '{_RX['test']}') then 'test_failure' else 'error' end
  when role = 'user' and regexp_matches(text, '{_RX['correction']}') then 'user_correction'
  when role = 'tool' and kind0 in ('', 'message') then 'command_output' when kind0 = '' then 'message' else kind0 end"""


@query(f"""with {_CLEAN}, j as (select c.id, c.role, c.exit_code, case when c.kind in ('status', 'error') then c.kind else '' end as kind0, lower(coalesce(e.tool_name, '')) as tool, coalesce(x.text, '') as text, coalesce(x.command, '') as command, coalesce(x.diff, '') as diff
  from clean c join session_events e on e.id = c.id join event_contents x on x.id = c.content_id) select id, {_KIND} as kind from j""")
def classify_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds derived again from role, tool, payload and exit code."""
    e = S.clean(table(spark, sf_dir, "session_events")).join(_contents(spark, sf_dir).withColumnRenamed("id", "content_id"), "content_id")
    kind0 = F.when(F.col("kind").isin("status", "error"), F.col("kind")).otherwise("")
    return e.select("id", N.classified(F.col("role"), kind0, F.col("tool_name"), F.col("command"), F.col("diff"), F.coalesce("text", F.lit("")), F.col("exit_code")).alias("kind"))


@query(f"select id, try_cast(nullif(regexp_extract(text, '{_RX['exit']}', 1), '') as int) as exit_code from event_contents")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(spark, sf_dir).select("id", N.exit_code(F.col("text")).alias("exit_code"))


@query(f"with {_CLEAN} select distinct content_id, sha256(role || chr(0) || kind || chr(0) || coalesce(text, '') || chr(0) || coalesce(text_sha256, '') || chr(0) || coalesce(command, '') || chr(0) || chr(0) || coalesce(diff, '') || chr(0) || chr(0) || chr(0)) as hash from clean join event_contents x on x.id = content_id")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.clean(table(spark, sf_dir, "session_events", "id", "content_id", "role", "kind", "ts")).select("content_id", "role", "kind")
    c = table(spark, sf_dir, "event_contents", "id", "text", "text_sha256", "command", "diff").withColumnRenamed("id", "content_id")
    none = F.lit("")
    return e.join(c, "content_id").select("content_id", N.content_hash(F.col("role"), F.col("kind"), F.col("text"), F.col("text_sha256"), F.col("command"), none, F.col("diff"), none, F.array().cast("array<string>")).alias("hash")).distinct()


# ---- event store ------------------------------------------------------------------------------------------------------------
@query(f"with {_DUP} select id, duplicate_of from dup")
def duplicate_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("id", "duplicate_of")


@query(f"with {_DUP} select content_id, arg_min(id, (duplicate_of is not null, {_ORD})) as event_id from dup group by 1")
def canonical_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.canonical(_events(spark, sf_dir))


@query(f"with {_CLEAN} select content_id, count(*) as occurrences from clean group by 1")
def occurrence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "session_events", "content_id").groupBy("content_id").agg(F.count("*").alias("occurrences"))


_LAST = f"last as (select session_id, count(*) as n, min(ts) as a, max(ts) as b, arg_max(kind, ({_ORD})) as k, arg_max(content_id, ({_ORD})) as c from clean group by 1)"


@query(f"""with {_CLEAN}, {_LAST} select s.id as session_id, coalesce(n, 0) as event_count, coalesce(a, 0) as started_at, coalesce(b, 0) as ended_at,
  case when k in ('error', 'test_failure') then 'failed' when k = 'status' and lower(x.text) in ('complete', 'completed') then 'complete' when coalesce(n, 0) > 0 then 'active' else 'unknown' end as status
  from sessions s left join last l on l.session_id = s.id left join event_contents x on x.id = l.c""")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.clean(table(spark, sf_dir, "session_events", "id", "session_id", "content_id", "source_id", "record_ordinal", "part_ordinal", "ts", "role", "kind"))
    return S.summaries(table(spark, sf_dir, "sessions", "id"), e, table(spark, sf_dir, "event_contents", "id", "text"))


@query(f"""with {_CLEAN}, p as (select c.id, arg_max(e.kind, (e.ts, e.id)) as linked_kind, any_value(c.kind) as kind from clean c join clean e on e.session_id = c.session_id and e.call_id = c.call_id and e.id < c.id where c.role = 'tool' and c.call_id <> '' group by 1)
select id, linked_kind, case when kind = 'error' and linked_kind = 'test' then 'test_failure' else kind end as kind from p""")
def call_result_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each tool result answers to, and its kind in that light."""
    return S.call_links(_events(spark, sf_dir))


@query(f"with {_DUP} select session_id, call_id, arg_max(id, ({_ORD})) as output_id, arg_max(struct_pack(v := exit_code), ({_ORD})).v as exit_code, arg_max(kind, ({_ORD})) as kind from dup where role = 'tool' and call_id <> '' and kind in {S.OUTPUT_KINDS} and duplicate_of is null group by 1, 2")
def command_last_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_outputs(_events(spark, sf_dir))


@query(f"""with {_DUP}, u as (select * from dup where duplicate_of is null), t as (select * from u where role = 'tool')
select c.id, arg_min(t.id, (t.ts, t.source_id, t.record_ordinal, t.part_ordinal, t.id)) as output_id from u c join t on t.session_id = c.session_id and t.call_id = c.call_id and t.id > c.id where c.kind in ('command', 'test') group by 1""")
def command_next_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.next_outputs(_events(spark, sf_dir))


@query("""select s.id, s.session_uid, coalesce(p.id, n.id) as parent_id, coalesce(p.task_lineage_id, n.task_lineage_id, s.task_lineage_id) as lineage from sessions s
  left join sessions p on p.session_uid = trim(s.parent_session_id) left join sessions n on p.id is null and n.agent = s.agent and n.native_id = trim(s.parent_session_id)""")
def lineage_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session takes the lineage of its parent, found by uid, else by native id of the same agent."""
    s = table(spark, sf_dir, "sessions", "id", "session_uid", "agent", "native_id", "parent_session_id", "task_lineage_id").withColumn("_p", F.trim("parent_session_id"))
    p = s.select(F.col("session_uid").alias("_p"), F.col("id").alias("pid"), F.col("task_lineage_id").alias("pl"))
    n = s.select("agent", F.col("native_id").alias("_p"), F.col("id").alias("nid"), F.col("task_lineage_id").alias("nl"))
    return s.join(p, "_p", "left").join(n, ["agent", "_p"], "left").select(
        "id", "session_uid", F.coalesce("pid", "nid").alias("parent_id"), F.when(F.col("pid").isNotNull(), F.coalesce("pl", "task_lineage_id")).otherwise(F.coalesce("nl", "task_lineage_id")).alias("lineage"))


@query("select c.id from event_contents c where not exists (select 1 from session_events e where e.content_id = c.id)")
def orphan_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "event_contents", "id").join(table(spark, sf_dir, "session_events", F.col("content_id").alias("id")), "id", "left_anti")


@query("select s.id from sessions s where not exists (select 1 from session_events e where e.session_id = s.id)")
def orphan_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sessions", "id").join(table(spark, sf_dir, "session_events", F.col("session_id").alias("id")), "id", "left_anti")


# ---- sessions ---------------------------------------------------------------------------------------------------------------
_FROM, _TO = 1772323200000, 1782864000000  # 2026-03-01 to 2026-07-01
_MISSING = "(select distinct agent, native_session_id as native_id from sources where state = 'missing')"


@query(f"""select s.id, session_uid, s.agent, started_at, ended_at, status, m.native_id is not null as source_missing from sessions s left join {_MISSING} m on m.agent = s.agent and m.native_id = s.native_id
where role_in_tree = 'root' and ended_at >= {_FROM} and started_at <= {_TO} order by ended_at desc, session_uid limit 100""")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.list_sessions(table(spark, sf_dir, "sessions"), table(spark, sf_dir, "sources", "agent", "native_session_id", "state"), from_ms=_FROM, to_ms=_TO)
    return s.select("id", "session_uid", "agent", "started_at", "ended_at", "status", "source_missing")


@query(f"""select s.id, session_uid, ended_at, m.native_id is not null as source_missing from sessions s left join {_MISSING} m on m.agent = s.agent and m.native_id = s.native_id
where s.agent = 'codex' order by ended_at desc, session_uid limit 50""")
def session_list_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.list_sessions(table(spark, sf_dir, "sessions"), table(spark, sf_dir, "sources", "agent", "native_session_id", "state"), agent="codex", subagents=True, limit=80)
    return s.select("id", "session_uid", "ended_at", "source_missing")


@query(f"with {_DUP} select session_id, row_number() over (partition by session_id order by {_ORD}) as n, id, role, kind, ts, duplicate_of from dup where session_id = (select min(id) from sessions where agent = 'claude')")
def session_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All occurrences of one session in order: the show command."""
    one = table(spark, sf_dir, "sessions", "id", "agent").where("agent = 'claude'").agg(F.min("id").alias("session_id"))
    e = _events(spark, sf_dir).join(F.broadcast(one), "session_id", "left_semi")
    return ranked(e, ["session_id"], list(S.ORDER)).select("session_id", "n", "id", "role", "kind", "ts", "duplicate_of")


_IDX = f"""idx as (select id as content_id, body_terms, command_terms from (select id, coalesce({sql_terms('b')}, []::varchar[]) as body_terms, coalesce({sql_terms('c')}, []::varchar[]) as command_terms from
  (select id, {sql_tokens('body')} as b, {sql_tokens('cmd')} as c from (select id, coalesce(text, '') || chr(10) || coalesce(diff, '') as body, coalesce(command, '') as cmd from event_contents))) where len(body_terms) > 0 or len(command_terms) > 0)"""
_TF = "len(list_filter(body_terms, lambda t: t = '{0}')) * 1.0 + len(list_filter(command_terms, lambda t: t = '{0}')) * 5.0"


def _sql_search(where: str, limit: int) -> str:
    a, b = _TF.format("rate"), _TF.format("limiter")
    s = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in (0, 1))
    return f"""with {_DUP}, {_IDX}, f as (select content_id, {a} as t0, {b} as t1, len(body_terms) + len(command_terms) as dl from idx),
st as (select count(*) as n, sum(dl) / count(*) as avgdl, sum((t0 > 0)::int) as d0, sum((t1 > 0)::int) as d1 from f), h as (select content_id, -({s}) as score from f, st where t0 > 0 and t1 > 0),
p as (select content_id, arg_min(id, o) as event_id, arg_min(ts, o) as ts, arg_min(session_id, o) as session_id, arg_min(kind, o) as kind, count(*) as raw_event_count from (select *, (duplicate_of is not null, {_ORD}) as o from dup) group by 1)
select event_id, content_id, session_uid, kind, raw_event_count, round(score, 6) as score from h join p using (content_id) join sessions s on s.id = p.session_id where {where} order by h.score, p.ts, event_id limit {limit}"""


def _search(spark: SparkSession, sf_dir: str, **filters) -> DataFrame:
    index = S.event_index(spread(_contents(spark, sf_dir)))
    h = S.search_events(index, _events(spark, sf_dir), table(spark, sf_dir, "sessions"), "rate limiter", **filters)
    return h if filters.get("whole") else h.select("event_id", "content_id", "session_uid", "kind", "raw_event_count", F.round("score", 6).alias("score"))


@query(_sql_search("true", 10))
def session_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir)


@query(_sql_search(f"p.kind = 'message' and s.agent = 'claude' and p.ts between {_FROM} and {_TO}", 50))
def session_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, kind="message", agent="claude", from_ms=_FROM, to_ms=_TO, limit=200)


_UPSERT = "select id as seq, session_uid, {t} as title, cwd, repository, task_lineage_id, project_id, started_at, ended_at from sessions"


@query(f"""with r as ({_UPSERT.format(t='title')} union all {_UPSERT.format(t="'late ' || title").replace("id as seq", "id + 1000000000 as seq")})
select session_uid, coalesce(arg_min(title, seq) filter (where title <> ''), '') as title, coalesce(arg_min(cwd, seq) filter (where cwd <> ''), '') as cwd, coalesce(arg_min(repository, seq) filter (where repository <> ''), '') as repository,
coalesce(arg_max(task_lineage_id, seq) filter (where task_lineage_id <> ''), '') as task_lineage_id, coalesce(arg_max(project_id, seq) filter (where project_id <> ''), '') as project_id,
coalesce(min(started_at) filter (where started_at > 0), 0) as started_at, max(ended_at) as ended_at from r group by 1""")
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions merged with a second delivery of each under a later title."""
    s = table(spark, sf_dir, "sessions").select(F.col("id").alias("seq"), "session_uid", "title", "cwd", "repository", "task_lineage_id", "project_id", "started_at", "ended_at")
    late = s.withColumns({"title": F.concat(F.lit("late "), "title"), "seq": F.col("seq") + 1_000_000_000})
    return S.upserted(s, late)


# ---- episodes ---------------------------------------------------------------------------------------------------------------
_SAID = f"""said as (select e.*, coalesce(x.text, '') as text, regexp_replace(lower({_strip("coalesce(x.text, '')")}), '[^\\p{{L}}\\p{{Nd}}]', '', 'g') as norm from dup e left join event_contents x on x.id = e.content_id where duplicate_of is null),
msgs as (select session_id, id, row_number() over (partition by session_id order by {_ORD}) as pos, norm from said where role = 'user' and kind in ('message', 'user_correction') and norm <> ''),
again as (select distinct c.id from msgs c join msgs p on p.session_id = c.session_id and p.pos < c.pos where p.norm = c.norm
  or len(list_filter(string_split(p.norm, ''), lambda k: contains(c.norm, k))) >= 0.8 * greatest(length(p.norm), length(c.norm)) - 1e-4),
anchored as (select s.*, case when kind in ('user_correction', 'error', 'test_failure') then kind when role = 'user' and kind = 'message' and {_strip('text')} <> '' then
  case when regexp_matches(text, '{_RX['scope']}') then 'scope_revision' when regexp_matches(text, '{_RX['design']}') then 'design_direction' when a.id is not null then 'requirement_restatement' end end as anchor
  from said s left join again a on a.id = s.id)"""


def _anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(E.anchors(_events(spark, sf_dir), table(spark, sf_dir, "event_contents", "id", "text")), "anchors")


@query(f"with {_DUP}, {_SAID} select id, anchor from anchored where anchor is not null")
def anchor_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchored(spark, sf_dir).where("anchor is not null").select("id", "anchor")


@query(f"with {_DUP}, {_SAID} select id from again")
def requirement_restatement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("duplicate_of is null and role = 'user' and kind in ('message', 'user_correction')")
    e = e.join(table(spark, sf_dir, "event_contents", F.col("id").alias("content_id"), "text"), "content_id")
    return E.restatements(e.select("session_id", "id", F.struct(*S.ORDER).alias("pos"), "text"))


_EPISODES = f"""st as (select session_id, arg_min(lower(text), ({_ORD})) as t from said where kind = 'status' and lower(text) in ('complete', 'completed', 'failed') group by 1),
eps as (select concat_ws(':', session_uid, a.id::varchar, anchor) as episode_id, a.id as event_id, a.ts, anchor, session_uid, task_lineage_id, project_id,
  case when lower(s.status) in ('complete', 'completed') then 'complete' when lower(s.status) = 'failed' then 'failed' when t in ('complete', 'completed') then 'complete' when t = 'failed' then 'failed' else 'unknown' end as task_status
  from anchored a join sessions s on s.id = a.session_id left join st on st.session_id = a.session_id where anchor is not null)"""


@query(f"with {_DUP}, {_SAID}, {_EPISODES} select episode_id, ts, anchor, session_uid, task_lineage_id, project_id, task_status from eps where ts between {_FROM} and {_TO} order by ts desc, episode_id limit 100")
def episode_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.episodes(_anchored(spark, sf_dir), table(spark, sf_dir, "sessions"), from_ms=_FROM, to_ms=_TO)
    return e.orderBy(F.desc("ts"), "episode_id").limit(100).drop("event_id")


@query(f"""with {_DUP}, {_SAID}, {_EPISODES} select count(*) as episodes, count(distinct session_uid) as sessions, count(distinct nullif(task_lineage_id, '')) as task_lineages, count(distinct nullif(project_id, '')) as projects,
{", ".join(f"count(*) filter (where anchor = '{a}') as {a}" for a in E.ANCHORS)}, {", ".join(f"count(*) filter (where task_status = '{t}') as status_{t}" for t in ("complete", "failed", "unknown"))} from eps""")
def episode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summary(E.episodes(_anchored(spark, sf_dir), table(spark, sf_dir, "sessions")))


@query(f"""with {_DUP}, {_SAID}, w as (select id, anchor, list(id) over (partition by session_id order by {_ORD} rows between 3 preceding and 5 following) as frame from anchored)
select id as event_id, anchor, array_to_string(frame, ',') as frame from w where anchor is not null""")
def episode_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.frames(_anchored(spark, sf_dir), 3, 5).select("event_id", "anchor", F.array_join("frame", ",").alias("frame"))


@query(f"""with {_DUP}, {_SAID}, {_EPISODES}, hit as (select event_id as id from ({_sql_search("true", 50)})), hits_at as (select session_id, id, ({_ORD}) as o from anchored where id in (select id from hit)),
m as (select a.id as event_id, string_agg(h.id, ',' order by h.id) as matched from anchored a join hits_at h on h.session_id = a.session_id and (a.ts, a.source_id, a.record_ordinal, a.part_ordinal, a.id) <= h.o where a.anchor is not null group by 1)
select episode_id, ts, anchor, task_status, matched from m join eps using (event_id)""")
def episode_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that hold an event that a search found, with the reasons; an episode lasts from its anchor to the end of the session."""
    hits = written(_search(spark, sf_dir, limit=50).select(F.col("event_id").alias("hit")), "hits")
    anchored = _anchored(spark, sf_dir)
    return E.episodes(anchored, table(spark, sf_dir, "sessions")).join(E.matched(anchored, hits), "event_id").select("episode_id", "ts", "anchor", "task_status", F.array_join("matched", ",").alias("matched"))


# ---- evidence ---------------------------------------------------------------------------------------------------------------
_OUT = f"outs as (select session_id, call_id, arg_max(struct_pack(v := exit_code), ({_ORD})).v as code, arg_max(kind, ({_ORD})) as out_kind from dup where role = 'tool' and call_id <> '' and kind in {S.OUTPUT_KINDS} and duplicate_of is null group by 1, 2)"
_CMDS = f"""{_OUT}, cmds as (select d.session_id, d.id as event_id, d.ts, x.command, d.kind, code as exit_code, case when out_kind is null then 'unknown' when out_kind in ('error', 'test_failure') or coalesce(code <> 0, false) then 'failure' when code = 0 then 'success' else 'unknown' end as outcome
  from dup d join event_contents x on x.id = d.content_id left join outs o on o.session_id = d.session_id and o.call_id = d.call_id where d.duplicate_of is null and d.kind in ('command', 'test') and coalesce(x.command, '') <> '')"""


@query(f"with {_DUP}, {_CMDS} select * from cmds")
def command_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.commands(_events(spark, sf_dir), _contents(spark, sf_dir))


@query(f"""with {_DUP}, {_CMDS}, j as (select d.*, coalesce(x.text, '') as text, coalesce(x.diff, '') as diff, d.duplicate_of is null as ok from dup d left join event_contents x on x.id = d.content_id),
f as (select *, ok and role = 'user' and kind in ('message', 'user_correction') and text <> '' as asked, ok and role = 'assistant' and kind = 'message' and text <> '' as answered from j),
c as (select session_id, count(*) as commands, count(*) filter (where outcome = 'failure') as failed_commands from cmds group by 1)
select session_id, count(*) filter (where asked) as user_inputs, count(*) filter (where asked and kind = 'user_correction') as corrections, count(*) filter (where ok and kind in ('error', 'test_failure')) as errors,
count(*) filter (where ok and kind = 'file_operation' and diff <> '') as diffs, count(*) filter (where not ok) as duplicate_events, arg_min(text, ({_ORD})) filter (where asked) as task, arg_max(text, ({_ORD})) filter (where answered) as final_response,
any_value(coalesce(c.commands, 0)) as commands, any_value(coalesce(c.failed_commands, 0)) as failed_commands from f left join c using (session_id) group by 1""")
def session_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.per_session(_events(spark, sf_dir), _contents(spark, sf_dir))


@query(f"""with {_DUP}, u as (select d.session_id, d.id, d.ts, d.source_id, d.record_ordinal, d.part_ordinal, strlen(x.text) + 1 as n from dup d join event_contents x on x.id = d.content_id where duplicate_of is null and role = 'user' and kind in ('message', 'user_correction') and text <> ''),
w as (select *, sum(n) over (partition by session_id) as total, sum(n) over (partition by session_id order by {_ORD} rows unbounded preceding) as up, row_number() over (partition by session_id order by {_ORD}) as k,
  sum(n) over (partition by session_id order by {_ORD} rows between current row and unbounded following) as down from u),
x as (select *, up <= 1000 or k = 1 as front from w), y as (select *, max(up) filter (where front) over (partition by session_id) as used from x)
select session_id, id from y where total <= 2000 or front or used + down <= 2000""")
def budget_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User inputs of each session within 2,000 bytes: half from the front, the rest from the back."""
    e = _events(spark, sf_dir).where("duplicate_of is null and role = 'user' and kind in ('message', 'user_correction')")
    e = e.join(table(spark, sf_dir, "event_contents", F.col("id").alias("content_id"), "text"), "content_id").where("text <> ''")
    return V.within_budget(e, "session_id", list(S.ORDER), F.octet_length("text") + 1, 2000).select("session_id", "id")
