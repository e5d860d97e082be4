"""Queries of nested documents and of file filters, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.operators import documents as D
from loomstack.operators import sessions as S
from loomstack.plans.transcripts import _CLEAN, _DUP, _EPISODES, _FROM, _IDX, _ORD, _SAID, _TO, _anchored, _events, _search
from loomstack.runtime import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return register


_EVENT_COLUMNS = ("id", "session_id", "content_id", "source_id", "record_ordinal", "part_ordinal", "byte_offset", "source_line", "native_event_id", "parent_native_id", "ts", "role", "kind", "tool_name", "call_id", "exit_code", "source_hash")


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.materialized(table(spark, sf_dir, "session_events", *_EVENT_COLUMNS))
    contents = table(spark, sf_dir, "event_contents", "id", "content_hash", "text", "text_truncated", "text_original_bytes", "text_sha256", "command", "diff")
    return D.full_events(events, contents, table(spark, sf_dir, "sources", "id", "path", "content_hash", "state"))


_PATHS = r"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(diff, ''), '(?m)^(?:\+\+\+ b/|\*\*\* (?:Add File|Update File|Delete File|Move to): )([^\r\n]+)', 1), lambda p: trim(p)), lambda p: p <> '')))"
_FILES = f"cf as (select id as content_id, unnest({_PATHS}) as path from event_contents where coalesce(diff, '') <> '')"


@query(f"with {_FILES} select content_id, string_agg(path, chr(10) order by path) as paths from cf group by 1")
def content_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.joined_paths(D.content_files(table(spark, sf_dir, "event_contents", "id", "diff")), "\n")


@query(f"with {_CLEAN}, {_FILES} select c.id from clean c where exists (select 1 from cf where cf.content_id = c.content_id and cf.path = 'audit')")
def events_touching_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = D.content_files(table(spark, sf_dir, "event_contents", "id", "diff"))
    return D.touching(table(spark, sf_dir, "session_events", "id", "content_id"), files, "audit").select("id")


@query("select c.id from event_contents c where exists (select 1 from session_events e where e.content_id = c.id)")
def indexed_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that some event refers to: those that the index of the store holds."""
    return table(spark, sf_dir, "event_contents", "id").join(table(spark, sf_dir, "session_events", F.col("content_id").alias("id")).distinct(), "id", "left_semi")


_STAMP = "case when {0} > 0 then regexp_replace(regexp_replace(strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%S.%g'), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || 'Z' else '' end"
_FULL = f"""full_events as (select d.*, {_STAMP.format('d.ts')} as timestamp, coalesce(x.text, '') as text, coalesce(x.command, '') as command, coalesce(x.diff, '') as diff, coalesce(x.content_hash, '') as content_hash,
  coalesce(s.path, '') as source_path, case when coalesce(e.source_hash, '') <> '' then e.source_hash else coalesce(s.content_hash, '') end as source_hash, coalesce(e.source_line, 0) as source_line, coalesce(s.state, '') as source_state,
  case when coalesce(x.diff, '') <> '' then {_PATHS.replace('diff', 'x.diff')} else []::varchar[] end as files
  from dup d join session_events e on e.id = d.id left join event_contents x on x.id = d.content_id left join sources s on s.id = d.source_id)"""


@query(f"with {_DUP}, {_FULL} select id, timestamp, sha256(text) as text_sha, sha256(command) as command_sha, content_hash, source_path, source_hash, source_line, source_state, array_to_string(files, ',') as files from full_events")
def full_session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with payload, files and source."""
    return _full(spark, sf_dir).select("id", "timestamp", F.sha2("text", 256).alias("text_sha"), F.sha2("command", 256).alias("command_sha"), "content_hash", F.col("source.path").alias("source_path"), F.col("source.hash").alias("source_hash"),
                                       F.col("source.line").alias("source_line"), F.col("source.state").alias("source_state"), F.array_join("files", ",").alias("files"))


_OUTS = f"""outs as (select session_id, call_id, arg_max(id, ({_ORD})) as output_id from full_events where role = 'tool' and call_id <> '' and kind in {S.OUTPUT_KINDS} and duplicate_of is null group by 1, 2)"""


@query(f"""with {_DUP}, {_FULL}, {_OUTS}, one as (select * from full_events where duplicate_of is null),
asked as (select * from one where role = 'user' and kind in ('message', 'user_correction') and text <> ''),
cmd as (select o.*, r.exit_code as code, r.kind as out_kind, r.text as out_text from one o left join outs q on q.session_id = o.session_id and q.call_id = o.call_id left join one r on r.id = q.output_id where o.kind in ('command', 'test') and o.command <> ''),
chg as (select session_id, path, min(({_ORD})) as first_at from (select *, unnest(files) as path from one where kind = 'file_operation') group by 1, 2),
df as (select session_id, count(*) as n, string_agg(diff, chr(10) order by {_ORD}) as all_diffs from one where kind = 'file_operation' and diff <> '' group by 1),
a as (select session_id, count(*) as n, arg_min(text, ({_ORD})) as task from asked group by 1),
f as (select session_id, arg_max(text, ({_ORD})) as final from one where role = 'assistant' and kind = 'message' and text <> '' group by 1),
c as (select session_id, count(*) as n, count(*) filter (where case when out_kind is null then 'unknown' when out_kind in ('error', 'test_failure') or coalesce(code <> 0, false) then 'failure' when code = 0 then 'success' else 'unknown' end = 'failure') as failed from cmd group by 1),
e as (select session_id, count(*) as n from one where kind in ('error', 'test_failure') group by 1),
p as (select session_id, count(*) as n, string_agg(path, ',' order by first_at, path) as paths from chg group by 1),
s as (select session_id, count(*) filter (where duplicate_of is not null) as dups from full_events group by 1)
select i.session_uid, {_STAMP.format('i.started_at')} as started_at, coalesce(a.task, '') as task, coalesce(f.final, '') as final_response, coalesce(a.n, 0) as user_inputs, coalesce(c.n, 0) as commands, coalesce(c.failed, 0) as failed, coalesce(e.n, 0) as errors, coalesce(p.paths, '') as files_changed,
sha256(coalesce(df.all_diffs, '')) as diff_sha, coalesce(strlen(df.all_diffs), 0) as diff_bytes, greatest(coalesce(df.n, 0) - 32, 0) as omitted_diff_sources, s.dups as duplicates
from s join sessions i on i.id = s.session_id left join a using (session_id) left join f using (session_id) left join c using (session_id) left join e using (session_id) left join p using (session_id) left join df using (session_id)""")
def evidence_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of every session; items kept and left out add up to all there are."""
    d = D.session_evidence(_full(spark, sf_dir), table(spark, sf_dir, "sessions"))
    count = lambda n: (F.size(n) + F.col(f"omitted.{n}")).alias(n)
    return d.select(
        F.col("session.id").alias("session_uid"), F.col("session.started_at").alias("started_at"), F.coalesce("task.text", F.lit("")).alias("task"), F.coalesce("final_response.text", F.lit("")).alias("final_response"), count("user_inputs"), count("commands"),
        F.size(F.filter("commands", lambda c: c["outcome"] == "failure")).cast("long").alias("failed"), count("errors"), F.array_join(F.transform("files_changed", lambda f: f["path"]), ",").alias("files_changed"),
        F.col("diff.sha256").alias("diff_sha"), F.col("diff.original_bytes").alias("diff_bytes"), F.col("omitted.diff_sources").alias("omitted_diff_sources"), F.col("omitted.duplicate_events").alias("duplicates"))


@query(f"""with {_DUP}, {_FULL}, {_SAID}, {_EPISODES}, n as (select id, session_id, row_number() over (partition by session_id order by {_ORD}) as n, anchor, role, kind, call_id, exit_code, text from anchored),
nx as (select c.id, arg_min(t.kind, (t.ts, t.source_id, t.record_ordinal, t.part_ordinal, t.id)) as k, arg_min(struct_pack(v := t.exit_code), (t.ts, t.source_id, t.record_ordinal, t.part_ordinal, t.id)).v as x, 1 as one
  from anchored c join anchored t on t.session_id = c.session_id and t.call_id = c.call_id and t.id > c.id and t.role = 'tool' where c.kind in ('command', 'test') group by 1),
o as (select n.id, case when kind in ('error', 'test_failure') or coalesce(exit_code <> 0, false) then 'failure' when exit_code = 0 then 'success'
  when kind = 'status' then case when lower(trim(text)) in {D.SUCCESS} then 'success' when lower(trim(text)) in {D.FAILURE} then 'failure' else 'unknown' end
  when kind in ('command', 'test') then case when nx.x = 0 then 'success' when nx.one = 1 and (nx.k in ('error', 'test_failure') or nx.x is not null) then 'failure' else 'unknown' end else 'unknown' end as result
  from n left join nx using (id) where kind in ('command', 'test', 'command_output', 'test_failure', 'error', 'status')),
fr as (select a.id as anchor_id, a.n as an, e.*, o.result from n a join n e on e.session_id = a.session_id and e.n between a.n - 3 and a.n + 5 left join o on o.id = e.id where a.anchor is not null),
g as (select anchor_id, string_agg(id, ',' order by n) filter (where n < an) as ctx, string_agg(id, ',' order by n) filter (where n = an or (n > an and role = 'user' and anchor in ('user_correction', 'requirement_restatement', 'scope_revision', 'design_direction'))) as cor,
  string_agg(id, ',' order by n) filter (where n > an) as act, string_agg(id || ':' || result, ',' order by n) filter (where result is not null) as outc, max(n) filter (where n > an and role = 'assistant' and kind = 'message') as fin, string_agg(id, ',' order by n) as ids,
  arg_min(case when lower(text) = 'failed' then 'failed' else 'complete' end, n) filter (where kind = 'status' and lower(text) in ('complete', 'completed', 'failed')) as said from fr group by 1)
select p.episode_id, coalesce(ctx, '') as context_before, coalesce(cor, '') as corrections, coalesce(act, '') as actions_after, coalesce(outc, '') as outcomes, coalesce(r.id::varchar, '') as final_report, ids as source_event_ids,
case when lower(s.status) in ('complete', 'completed') then 'complete' when lower(s.status) = 'failed' then 'failed' else coalesce(said, 'unknown') end as task_status
from g join eps p on p.event_id = g.anchor_id join sessions s on s.session_uid = p.session_uid left join n r on r.session_id = s.id and r.n = g.fin""")
def episode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of every episode, three events ahead and five behind, as lists of ids."""
    d = _episode_documents(spark, sf_dir, before=3, after=5)
    ids = lambda n: F.array_join(F.transform(n, lambda x: x["event_id"].cast("string")), ",").alias(n)
    return d.select(
        "episode_id", ids("context_before"), ids("corrections"), ids("actions_after"), F.array_join(F.transform("outcomes", lambda o: F.concat(o["event_id"].cast("string"), F.lit(":"), o["outcome"])), ",").alias("outcomes"),
        F.coalesce(F.col("final_report.event_id").cast("string"), F.lit("")).alias("final_report"), F.array_join("source_event_ids", ",").alias("source_event_ids"), "task_status")


def _episode_documents(spark: SparkSession, sf_dir: str, **bounds) -> DataFrame:
    anchored = _full(spark, sf_dir).where("duplicate_of is null").join(_anchored(spark, sf_dir).select("id", "anchor"), "id")
    return D.episode_documents(anchored, table(spark, sf_dir, "sessions"), **bounds)


@query()
def budget_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes within 2,000 bytes: what is kept and what is left out of each."""
    d = _episode_documents(spark, sf_dir, before=3, after=5, byte_budget=2000)
    return d.select("episode_id", F.array_join("source_event_ids", ",").alias("kept"), "omitted.*")


_TERMS = "len(list_filter(body_terms, lambda t: t = '{0}')) + len(list_filter(command_terms, lambda t: t = '{0}'))"


@query(f"""with {_DUP}, {_IDX}, h as (select content_id from idx where {_TERMS.format('rate')} > 0 and {_TERMS.format('limiter')} > 0),
p as (select content_id, arg_min(session_id, (duplicate_of is not null, {_ORD})) as session_id, arg_min(ts, (duplicate_of is not null, {_ORD})) as ts, count(*) as n from dup group by 1)
select coalesce(sum(n), 0)::bigint as raw_events, count(distinct session_uid) as sessions, count(distinct nullif(task_lineage_id, '')) as task_lineages, count(distinct nullif(project_id, '')) as projects
from h join p using (content_id) join sessions s on s.id = p.session_id where p.ts between {_FROM} and {_TO}""")
def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all hits of a search, whatever the limit of a listing is."""
    return D.search_summary(_search(spark, sf_dir, from_ms=_FROM, to_ms=_TO, whole=True))
