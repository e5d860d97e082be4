"""Queries of the general training-data problems (1, 2, 4, 7) and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.operators import dedup, hierarchy, incremental, timestamps
from loomstack.runtime import table, written


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "sources", "id", "logical_id", "cursor_offset", "cursor_ordinal", "content_hash")
    return incremental.new_rows(incremental.log_lines(spark, sf_dir), sources).select("record_id")


def p1_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and logs that the next batch reads, by kind of reading."""
    sources = table(spark, sf_dir, "sources", "id", "logical_id", "cursor_offset", "cursor_ordinal", "content_hash")
    lines = incremental.log_lines(spark, sf_dir)
    plan = incremental.planned(lines.drop("line"), incremental.log_states(lines, incremental.source_offsets(sources)))
    logs = plan.groupBy("mode", "logical_id").agg(F.count("*").alias("n"))
    return logs.groupBy(F.col("mode").alias("generation")).agg(F.sum("n").alias("rows_to_read"), F.count("*").alias("logs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.found(spark, sf_dir)


def p2_local_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many log lines have a local time that occurs never, once or twice on their clock."""
    lines = timestamps.timestamp_lines(spark, sf_dir)
    t = timestamps.line_instants(lines, table(spark, sf_dir, "discovered", "logical_id", "clock_zone"))
    return t.groupBy("origin", "matches").agg(F.count("*").alias("lines"), F.count("instant_us").alias("with_instant"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.found(spark, sf_dir)


def p4_session_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and number of descendants of every session that is not on or below a loop."""
    links = hierarchy.session_links(table(spark, sf_dir, "sessions", "id", "session_uid", "agent", "native_id", "parent_session_id"))
    t = written(hierarchy.tours(links), "tours")
    return t.join(hierarchy.paths(t, ">"), "did").select("node", "root", "depth", "descendants", "path")


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and number of descendants of every event and session; on or below a loop '', -1, '' and null."""
    t = written(hierarchy.all_tours(spark, sf_dir), "tours")
    return t.join(hierarchy.paths(t, ">"), "did", "left").select(hierarchy.scope_of_result(), "node", "root", "depth", "descendants", F.coalesce("path", F.lit("")).alias("path"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.surplus(table(spark, sf_dir, "session_events", "id", "session_id", "part_ordinal", "native_event_id", "source_id"))


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per session before and after."""
    e = table(spark, sf_dir, "session_events", "id", "session_id", "part_ordinal", "native_event_id", "source_id")
    s = dedup.surplus(e).withColumnRenamed("event_id", "id").withColumn("gone", F.lit(1))
    return e.join(s, "id", "left").groupBy("session_id").agg(
        F.count("*").alias("delivered"), (F.count("*") - F.count("gone")).alias("kept"))


QUERIES = {f.__name__: f for f in (p1_found, p1_plan, p2_found, p2_local_matches, p4_found, p4_session_paths, p4_paths, p7_found, p7_kept)}

_TRIM = r"regexp_replace({0}, '^[\s\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')"


def _fold(c: str) -> str:
    return f"lower({_TRIM.format(c)})"


_P1 = """
with lines as (select record_id, logical_id, record_ordinal, byte_offset, terminated, line from codex
               union all select record_id, logical_id, record_ordinal, byte_offset, terminated, line from pi),
bytes as (select l.logical_id, s.cursor_offset, s.content_hash,
                 string_agg(coalesce(line, '') || case when terminated then chr(10) else '' end, '' order by record_ordinal) as t
          from lines l join sources s using (logical_id) where byte_offset < s.cursor_offset group by all),
state as (select s.logical_id, s.cursor_ordinal,
                 coalesce(sha256(substr(encode(t), 1, s.cursor_offset)) = s.content_hash, s.content_hash = sha256('')) as same
          from sources s left join bytes b using (logical_id)),
todo as (select l.record_id, l.logical_id, case when same then 'append' else 'rebuild' end as generation
         from lines l left join state s using (logical_id)
         where terminated and (same is null or not same or record_ordinal > cursor_ordinal))
"""
_P1 = _P1.replace("sha256(substr(encode(t), 1, s.cursor_offset))", "sha256(cast(unhex(substr(hex(encode(t)), 1, 2 * s.cursor_offset)) as blob))")

_P4 = f"""
with recursive links as (
  select session_id as scope_id, {_fold('native_event_id')} as node, {_fold("arg_min(coalesce(parent_native_id, ''), id)")} as parent
  from session_events where {_TRIM.format("coalesce(native_event_id, '')")} <> '' group by 1, 2
  union all
  select 0, {_fold('s.session_uid')}, coalesce({_fold('u.session_uid')}, {_fold('n.session_uid')}, '')
  from sessions s left join sessions u on {_fold('u.session_uid')} = {_fold('s.parent_session_id')}
  left join sessions n on n.agent = s.agent and {_fold('n.native_id')} = {_fold('s.parent_session_id')}),
edges as (select l.scope_id, l.node, p.node as parent from links l left join links p on p.scope_id = l.scope_id and p.node = l.parent),
walk as (select scope_id, node, node as root, 0::bigint as depth, node as path from edges where parent is null
         union all select e.scope_id, e.node, w.root, w.depth + 1, w.path || '>' || e.node from walk w join edges e on e.scope_id = w.scope_id and e.parent = w.node)
"""
_P4S = _P4.replace(_P4[_P4.index("  select session_id"):_P4.index("  union all\n") + len("  union all\n")], "").replace("select 0, ", "select 0::bigint as scope_id, ", 1)
_P4S = _P4S.replace("0::bigint as scope_id, " + _fold("s.session_uid") + ",", "0::bigint as scope_id, " + _fold("s.session_uid") + " as node,", 1).replace(", '')\n  from sessions s", ", '') as parent\n  from sessions s", 1)
_P7_KEY = f"id, session_id, part_ordinal, {_fold('native_event_id')} as k"

SQL = {
    "p1_found": _P1 + "select record_id from todo",
    "p1_plan": _P1 + "select generation, count(*) as rows_to_read, count(distinct logical_id) as logs from todo group by 1",
    "p4_found": _P4 + "select e.scope_id, e.node, coalesce(w.root, '') as root, coalesce(w.depth, -1) as depth from edges e left join walk w on w.scope_id = e.scope_id and w.node = e.node where e.parent is not null",
    "p4_session_paths": _P4S + """, sub as (select w.node, count(*) - 1 as descendants from walk w join walk d on d.path = w.path or starts_with(d.path, w.path || '>') group by 1)
select w.node, w.root, w.depth, s.descendants, w.path from walk w join sub s on s.node = w.node""",
    "p4_paths": _P4 + """, sub as (select w.scope_id, w.node, count(*) - 1 as descendants from walk w join walk d on d.scope_id = w.scope_id and d.root = w.root and (d.path = w.path or starts_with(d.path, w.path || '>')) group by 1, 2)
select e.scope_id, e.node, coalesce(w.root, '') as root, coalesce(w.depth, -1) as depth, s.descendants, coalesce(w.path, '') as path from edges e left join walk w on w.scope_id = e.scope_id and w.node = e.node left join sub s on s.scope_id = e.scope_id and s.node = e.node""",
    "p7_found": f"select id as event_id from (select {_P7_KEY} from session_events where {_TRIM.format('native_event_id')} <> '') qualify row_number() over (partition by session_id, part_ordinal, k order by id) > 1",
    "p7_kept": f"select session_id, count(*) as delivered, count(*) filter (where coalesce(k, '') = '' or r = 1) as kept from (select session_id, k, row_number() over (partition by session_id, part_ordinal, k order by id) as r from (select {_P7_KEY} from session_events)) group by 1",
}
