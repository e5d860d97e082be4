"""Queries of the reading side: file filters, logs, differences, relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.operators import evalmetrics, incremental, snapshot

from loomstack.runtime import table
from loomstack.sources import files as FS
from loomstack.sources import logs

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return register


@query(r"select id, path from files where not regexp_matches(path, '(?:^|/)(?:\.git|\.loomstack)(?:/|$)|\.uid$|\.import$') and size > 0 and size <= 1048576")
def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FS.filtered(table(spark, sf_dir, "files", "id", "path", "size")).select("id", "path")


_RULES = "docs/\n*.env\n!src/**/*.env\n/scripts\ncmd/**/*.sh\n"


@query(r"""select id, path, case when regexp_matches(path, '^cmd/(?:.*/)?[^/]*\.sh(?:/|$)') then true when regexp_matches(path, '^scripts(?:/|$)') then true
  when regexp_matches(path, '^src/(?:.*/)?[^/]*\.env(?:/|$)') then false when regexp_matches(path, '(?:^|/)[^/]*\.env(?:/|$)') then true when regexp_matches(path, '(?:^|/)docs/') then true else false end as ignored from files""")
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files", "id", "path").select("id", "path", FS.IgnoreRules(_RULES).ignored(F.col("path")).alias("ignored"))


@query("select doc_id, sha256(text) as hash from documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("hash"))


@query(r"""select id, not contains(raw_body, chr(0)) and len(regexp_replace(substring(raw_body, 1, 8000), '[^\x01-\x08\x0e-\x1a\x1c-\x1f]', '', 'g')) * 100 // greatest(strlen(substring(raw_body, 1, 8000)), 1) < 5 as text from chunks where raw_body is not null""")
def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "chunks", "id", "raw_body").where("raw_body is not null")
    return c.select("id", FS.is_text(F.encode("raw_body", "UTF-8")).alias("text"))


@query("""with now as (select logical_id, sha256(string_agg(coalesce(line, '') || chr(10), '' order by record_ordinal)) as h from (select logical_id, record_ordinal, line, terminated from codex union all select logical_id, record_ordinal, line, terminated from pi) where terminated group by 1),
old as (select logical_id, content_hash as h from sources where agent in ('codex', 'pi'))
select coalesce(o.logical_id, n.logical_id) as logical_id, case when o.logical_id is null then 'added' when n.logical_id is null then 'removed' when o.h is not distinct from n.h then 'unchanged' else 'updated' end as change from old o full join now n on o.logical_id = n.logical_id""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs whose bytes are no longer those of the store."""
    stored = table(spark, sf_dir, "sources", "logical_id", "agent", "content_hash").where("agent in ('codex', 'pi')")
    now = incremental.log_digests(incremental.log_lines(spark, sf_dir))
    return snapshot.diff(stored, now, "logical_id", "content_hash")


@query("""with d as (select logical_id, max((mtime_ns, size, file_id)) as m from discovered group by 1), e as (select logical_id, m[1] as mtime_ns, m[2] as size, m[3] as file_id from d)
select coalesce(s.logical_id, e.logical_id) as logical_id, case when s.logical_id is null then 'new' when e.logical_id is null then 'missing' when s.size = e.size and s.mtime_ns = e.mtime_ns then 'unchanged'
 when s.file_id is not distinct from e.file_id and e.size > s.size then 'extend' else 'rebuild' end as plan from sources s full join e on s.logical_id = e.logical_id""")
def source_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.source_plan(table(spark, sf_dir, "sources", "logical_id", "size", "mtime_ns", "file_id"), table(spark, sf_dir, "discovered", "logical_id", "size", "mtime_ns", "file_id"))


@query("select agent, count(*) as sources, count(*) filter (where state = 'error') as errors, count(*) filter (where state = 'missing') as missing, sum(malformed_count)::bigint as malformed, sum(cursor_offset)::bigint as bytes_read from sources group by 1")
def sync_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sources", "agent", "state", "malformed_count", "cursor_offset")
    return s.groupBy("agent").agg(F.count("*").alias("sources"), F.count_if(F.col("state") == "error").alias("errors"), F.count_if(F.col("state") == "missing").alias("missing"), F.sum("malformed_count").alias("malformed"), F.sum("cursor_offset").alias("bytes_read"))


@query("select (select count(*) from files) as files, (select count(*) from chunks) as chunks, (select count(distinct file_id) from chunks) as chunked_files, (select count(*) from session_events) as events, (select count(*) from sessions) as sessions")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda t, c="*", d=False: table(spark, sf_dir, t).agg((F.count_distinct(c) if d else F.count(c)).alias("n"))
    parts = [n("files").withColumnRenamed("n", "files"), n("chunks").withColumnRenamed("n", "chunks"), n("chunks", "file_id", True).withColumnRenamed("n", "chunked_files"), n("session_events").withColumnRenamed("n", "events"), n("sessions").withColumnRenamed("n", "sessions")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def _lines(spark: SparkSession, sf_dir: str, agent: str) -> DataFrame:
    return table(spark, sf_dir, agent, "logical_id", "record_ordinal", "byte_offset", "terminated", "line").where("terminated")


_VALID = "case when json_valid(line) then line end"


@query(f"""with l as (select logical_id, record_ordinal, byte_offset, {_VALID} as j from codex where terminated), m as (select logical_id, record_ordinal, lower(j ->> '$.payload.role') as role, cast(j -> '$.payload.content' as json[]) as c from l
  where (j ->> '$.type') = 'response_item' and (j ->> '$.payload.type') = 'message' and lower(j ->> '$.payload.role') in ('user', 'assistant')), b as (select logical_id, record_ordinal, role, unnest(c) as b, generate_subscripts(c, 1) as part_ordinal from m)
select logical_id, record_ordinal, part_ordinal::bigint as part_ordinal, role, coalesce(b ->> '$.text', '') as text from b where (b ->> '$.type') in ('input_text', 'output_text', 'text')""")
def decode_codex_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = logs.records(_lines(spark, sf_dir, "codex"), "codex").where("kind = 'message' and part_ordinal > 0")
    return r.select("logical_id", "record_ordinal", "part_ordinal", "role", "text")


@query(f"""with l as (select logical_id, record_ordinal, {_VALID} as j, json_valid(line) as ok, trim(line) = '' as blank from codex where terminated)
select count(*) filter (where not ok and not blank) as malformed, count(*) filter (where (j ->> '$.payload.type') in ('function_call', 'custom_tool_call') and (j ->> '$.type') = 'response_item') as calls,
count(*) filter (where (j ->> '$.payload.type') in ('function_call_output', 'custom_tool_call_output') and (j ->> '$.type') = 'response_item') as outputs, count(*) filter (where (j ->> '$.type') = 'event_msg' and (j ->> '$.payload.type') = 'task_complete') as completions from l""")
def decode_codex_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = logs.records(_lines(spark, sf_dir, "codex"), "codex")
    return r.agg(F.count_if("malformed").alias("malformed"), F.count_if(F.col("kind") == "tool").alias("calls"), F.count_if((F.col("kind") == "command_output") & (F.col("role") == "tool")).alias("outputs"), F.count_if(F.col("kind") == "status").alias("completions"))


@query()
def decode_pi_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.records(_lines(spark, sf_dir, "pi"), "pi").drop("paths")


@query(r"""with l as (select logical_id, record_ordinal, case when json_valid(line) then line end as j from pi where terminated and record_ordinal <= 64)
select logical_id, coalesce(arg_max(j ->> '$.id', record_ordinal) filter (where (j ->> '$.type') = 'session' and trim(j ->> '$.id') <> ''), string_split(logical_id, '/')[-1]) as native_session_id from l group by logical_id""")
def session_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.headers(_lines(spark, sf_dir, "pi")).select("logical_id", "native_session_id")


_STEM = r"regexp_extract(path, '_([^_/.]*)[.][^./]*$', 1)"


@query(f"""with g as (select 'find ' || id as task, path, {_STEM} as token from files), c as (select path, start_line, end_line - start_line + 1 as lines, {_STEM} as token from chunks),
k as (select g.task, c.lines, row_number() over (partition by task order by length(c.path), c.path, c.start_line) as rank, (c.path = g.path)::int as good, c.path from g join c using (token) where token <> ''),
w as (select *, coalesce(max(good) over (partition by task order by rank rows between unbounded preceding and 1 preceding), 0) as before from k),
t as (select task, min(rank) filter (where good = 1) as first_rank, sum(case when before = 0 then lines else 0 end) as lines_read, count(distinct path) filter (where good = 1 and rank <= 1) as h1, count(distinct path) filter (where good = 1 and rank <= 5) as h5, count(distinct path) filter (where good = 1 and rank <= 10) as h10 from w group by 1),
a as (select g.task, first_rank, coalesce(lines_read, 0) as lines_read, coalesce(h1, 0) as h1, coalesce(h5, 0) as h5, coalesce(h10, 0) as h10 from g left join t using (task))
select count(*) as tasks, count(first_rank) as tasks_hit, round(avg(coalesce(1 / first_rank, 0)), 6) as mrr, round(avg(first_rank), 6) as avg_first_rank, sum(lines_read)::bigint as lines_read,
round(avg((h1 > 0)::int), 6) as success_1, round(avg((h5 > 0)::int), 6) as success_5, round(avg((h10 > 0)::int), 6) as success_10, round(avg(h1), 6) as coverage_1, round(avg(h5), 6) as coverage_5, round(avg(h10), 6) as coverage_10 from a""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per file: find it by the distinctive part of its name; all tasks are ranked and measured in one job."""
    from pyspark.sql import Window

    g = table(spark, sf_dir, "files", "id", "path").select(F.concat(F.lit("find "), F.col("id").cast("string")).alias("task"), F.col("path").alias("gold"), F.expr(_STEM).alias("token"))
    c = table(spark, sf_dir, "chunks", "path", "start_line", "end_line").select("path", "start_line", (F.col("end_line") - F.col("start_line") + 1).alias("lines"), F.expr(_STEM).alias("token"))
    w = Window.partitionBy("task").orderBy(F.length("path"), "path", "start_line")
    ranked = g.where("token <> ''").join(c, "token").withColumn("rank", F.row_number().over(w)).select("task", "rank", "path", "lines")
    return evalmetrics.overall(evalmetrics.per_task(ranked, g.select("task", F.col("gold").alias("path"))))
