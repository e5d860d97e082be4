"""Registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.llm import conversations, packing, pii, secrets, subjects, tokens
from loomstack.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(spark, sf_dir)


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contents with typed placeholders in place of personal data."""
    return pii.redacted(table(spark, sf_dir, "event_contents", "id", "text", "command"), table(spark, sf_dir, "name_parts"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found(spark, sf_dir)


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks with their secrets blanked in place."""
    return secrets.redacted(table(spark, sf_dir, "chunks", "id", "file_id", "start_line", "end_line", "raw_body"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.found(spark, sf_dir)


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.turns(spark, sf_dir)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.ids(spark, sf_dir)


def p8_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.frequencies(spark, sf_dir)


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_tables(spark, sf_dir)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(spark, sf_dir)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.found(spark, sf_dir)


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each subject, found and labelled."""
    found = subjects.found(spark, sf_dir).withColumn("by", F.lit("found"))
    known = table(spark, sf_dir, "subject_labels", "doc_id", "subject").withColumn("by", F.lit("label"))
    return found.unionByName(known).groupBy("subject", "by").agg(F.count_distinct("doc_id").alias("documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_redacted, p5_found, p5_redacted, p6_found, p6_turns, p8_ids, p8_frequencies, p9_packed, p9_fill, p10_found, p10_composition)}

_WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"
_P6 = rf"""
with keyed as (select *, lower(regexp_replace(native_event_id, '^{_WS}+|{_WS}+$', '', 'g')) as k from session_events),
uniq as (select * from keyed qualify coalesce(k, '') = '' or row_number() over (partition by session_id, part_ordinal, k order by id) = 1),
kept as (select * from uniq where kind in ('message', 'user_correction')),
parts as (select e.session_id, coalesce(e.record_ordinal, -1) as record_ordinal, case when e.record_ordinal is null then e.id end as lone, coalesce(e.part_ordinal, -1) as o, e.id, c.text,
  coalesce(lower(regexp_replace(e.role, '^{_WS}+|{_WS}+$', '', 'g')), '') as r0 from kept e join event_contents c on c.id = e.content_id where regexp_replace(c.text, '{_WS}+', '', 'g') <> ''),
named as (select *, case when r0 in ('toolresult', 'tool_result') then 'tool' when r0 in ('user', 'assistant', 'tool', 'system') then r0 else '' end as r from parts),
msgs as (select session_id, record_ordinal, lone, arg_min(r, (o, id)) as role, max((r = '')::int) as foreign_role, count(*) as parts, string_agg(text, chr(10) order by o, id) as text from named group by all),
talk as (select *, lead(role) over w as nxt, row_number() over w as rn from msgs where role in ('user', 'assistant') window w as (partition by session_id order by record_ordinal, lone)),
per as (select session_id, max(foreign_role) as f, any_value(1) as one from msgs group by 1),
t as (select session_id, max((rn = 1 and role <> 'user')::int) as bad_start, max((role = 'user' and coalesce(nxt, 'user') <> 'assistant')::int) as unanswered from talk group by 1),
everyone as (select id as session_id from sessions union select session_id from session_events where session_id is not null),
v as (select e.session_id, case when per.one is null then 'empty' when per.f = 1 or t.bad_start = 1 then 'broken' when t.unanswered = 1 then 'no_reply' end as reason
  from everyone e left join per using (session_id) left join t using (session_id))
"""
SQL = {
    "p6_found": _P6 + "select session_id, reason from v where reason is not null",
    "p6_turns": _P6 + "select session_id, record_ordinal, role, parts, m.text as text from msgs m join v using (session_id) where reason is null",
}
