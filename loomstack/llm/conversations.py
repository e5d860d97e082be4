"""Problem 6: message rows back into ordered conversations, unusable ones told with the reason.

The rows are an event log. Folding it by version: creates, edits, deletes, retries and redeliveries of one event share an identifier; the
sorted store of problem 7 keeps its last version (of equal versions the lowest id, which is a retry's first delivery), and an event whose last
version is a delete falls out. This project's table knows no versions, so there all rows of an identifier are retries; sources that edit give
the two columns to ``verdicts`` and ``turns``. Rows whose text is blank fall out; what is left with the same record ordinal is one
message, its parts in order. A message's role is that of its first part; a part with a foreign role makes the message foreign.

Validation folds each session without ever gathering it: messages are summarised per (session, block of BLOCK ordinals) as (first
speaker, last speaker, two users in a row), a summary that composes; the few block summaries of a session are then composed in order.
A session that holds a third of all rows is just many blocks.

Defined results: sessions without events are 'empty'; null and unknown roles are foreign ('broken'); a missing or null content is
blank; a row with a null ordinal is a message of its own, ahead of those with one, by id (nothing tells what belongs together, and so no
unbounded set of parts is ever gathered); a null version is the lowest; events of a session that the sessions table lacks form a session
too; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.functions.scalars import folded, non_blank
from loomstack.operators import dedup
from loomstack.runtime import table

BLOCK = 4096
# Kinds of events that are messages, and the spellings of the four roles.
MESSAGE_KINDS = ("message", "user_correction")
ROLES = ("user", "assistant", "tool", "system")


def speaker(role: Column) -> Column:
    """One of ROLES, or '' for anything else."""
    r = folded(role)
    r = F.when(r.isin("toolresult", "tool_result"), "tool").otherwise(r)
    return F.when(r.isin(*ROLES), r).otherwise("")


def parts(events: DataFrame, contents: DataFrame, with_text: bool = False, version: Column | None = None, deleted: Column | None = None) -> DataFrame:
    """Message parts of the last versions, with a text that is not blank. ``lone`` is the id of a part without an ordinal."""
    kept = dedup.folded_versions(events, version, deleted).where(F.col("kind").isin(*MESSAGE_KINDS))
    texts = contents.where(non_blank(F.col("text"))).select(F.col("id").alias("content_id"), *(["text"] if with_text else []))
    return kept.join(texts, "content_id", "inner" if with_text else "left_semi").select(
        "session_id", F.coalesce("record_ordinal", F.lit(-1)).cast("long").alias("record_ordinal"), F.when(F.col("record_ordinal").isNull(), F.col("id")).alias("lone"), "part_ordinal", "id", speaker(F.col("role")).alias("role"),
        *(["text"] if with_text else []))


MESSAGE = ("session_id", "record_ordinal", "lone")


def messages(p: DataFrame) -> DataFrame:
    """MESSAGE, role and foreign of each message."""
    return p.groupBy(*MESSAGE).agg(
        F.min_by("role", F.struct(F.coalesce("part_ordinal", F.lit(-1)), F.col("id"))).alias("role"), F.max((F.col("role") == "").cast("int")).alias("foreign"))


def _compose(items: Column, item) -> Column:
    """Fold of (first, last, twice) summaries in order."""
    zero = F.struct(F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last"), F.lit(False).alias("twice"))

    def step(acc: Column, x: Column) -> Column:
        first, last, twice = item(x)
        return F.struct(
            F.coalesce(acc["first"], first).alias("first"), F.coalesce(last, acc["last"]).alias("last"),
            (acc["twice"] | twice | F.coalesce((acc["last"] == "user") & (first == "user"), F.lit(False))).alias("twice"))

    return F.aggregate(items, zero, step)


def verdicts(sessions: DataFrame, events: DataFrame, contents: DataFrame, version: Column | None = None, deleted: Column | None = None) -> DataFrame:
    """(session_id, reason) of every session; a usable one has a null reason."""
    place = F.struct(F.col("lone").isNull().alias("placed"), F.floor(F.coalesce("lone", "record_ordinal") / BLOCK).alias("n"))
    m = messages(parts(events, contents, version=version, deleted=deleted)).withColumn("block", place)
    talk = F.col("role").isin("user", "assistant")
    blocks = m.groupBy("session_id", "block").agg(
        F.max("foreign").alias("foreign"), F.array_sort(F.collect_list(F.when(talk, F.struct("record_ordinal", "lone", "role")))).alias("turns"))
    blocks = blocks.select("session_id", "block", "foreign", _compose(F.col("turns"), lambda x: (x["role"], x["role"], F.lit(False))).alias("s"))
    whole = blocks.groupBy("session_id").agg(F.max("foreign").alias("foreign"), F.array_sort(F.collect_list(F.struct("block", "s"))).alias("blocks")).select(
        "session_id", "foreign", _compose(F.col("blocks"), lambda x: (x["s"]["first"], x["s"]["last"], x["s"]["twice"])).alias("s"), F.lit(True).alias("any"))
    everyone = sessions.select(F.col("id").alias("session_id")).unionByName(events.select("session_id")).where("session_id is not null").distinct()
    reason = (
        F.when(F.col("any").isNull(), "empty")
        .when((F.col("foreign") == 1) | F.coalesce(F.col("s.first") != "user", F.lit(False)), "broken")
        .when(F.col("s.twice") | F.coalesce(F.col("s.last") == "user", F.lit(False)), "no_reply"))
    return everyone.join(whole, "session_id", "left").select("session_id", reason.alias("reason"))


def _tables(spark: SparkSession, sf_dir: str):
    return (table(spark, sf_dir, "sessions", "id"),
            table(spark, sf_dir, "session_events", "id", "session_id", "content_id", "source_id", "record_ordinal", "part_ordinal", "native_event_id", "role", "kind"),
            table(spark, sf_dir, "event_contents", "id", "text"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(*_tables(spark, sf_dir)).where("reason is not null")


def rebuilt(sessions: DataFrame, events: DataFrame, contents: DataFrame, version: Column | None = None, deleted: Column | None = None) -> DataFrame:
    """(session_id, record_ordinal, role, parts, text) of the usable conversations, one row per message.

    Parts of one message are gathered, and only they: a message is one log line, of bounded length.
    """
    good = verdicts(sessions, events, contents, version, deleted).where("reason is null").select("session_id")
    p = parts(events, contents, True, version, deleted).join(good, "session_id", "left_semi")
    part = F.struct(F.coalesce("part_ordinal", F.lit(-1)).alias("o"), "id", "text")
    return p.groupBy(*MESSAGE).agg(
        F.min_by("role", F.struct(F.coalesce("part_ordinal", F.lit(-1)), F.col("id"))).alias("role"), F.count("*").alias("parts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "\n").alias("text")).drop("lone")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt(*_tables(spark, sf_dir))
