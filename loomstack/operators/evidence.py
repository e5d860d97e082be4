"""Evidence of sessions: requests, commands with their outcomes, errors, files and the last answer, within byte budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstack.operators import sessions as S
from loomstack.operators.episodes import outcome
from loomstack.operators.ranks import ranked

BUDGETS = {"user": 160 << 10, "command": 320 << 10, "file": 64 << 10, "error": 192 << 10}


def within_budget(items: DataFrame, group: str, order: list[str], size: Column, budget: int) -> DataFrame:
    """Keep items from the front up to half the budget (at least one), then from the back as far as the rest goes, if all do not fit.

    Running sums instead of a fold: the front is a prefix, the back the suffix that fits into what the front left.
    """
    x = ranked(items, [group], order, {"n": size})
    front = (F.col("upto_n") <= budget // 2) | (F.col("n") == 1)
    used = x.where(front).groupBy(group).agg(F.max("upto_n").alias("_used"))
    x = x.join(used, group)
    down = F.col("all_n") - F.col("upto_n") + F.coalesce(size.cast("long"), F.lit(0))  # this item and all behind it
    return x.where((F.col("all_n") <= budget) | front | (F.col("_used") + down <= budget)).drop("n", "of", "upto_n", "all_n", "_used")


def commands(events: DataFrame, contents: DataFrame) -> DataFrame:
    """(session_id, event_id, command, kind, exit_code, outcome): commands and tests with the last output of their call."""
    c = events.where("duplicate_of is null and kind in ('command', 'test')").join(contents.select(F.col("id").alias("content_id"), "command"), "content_id").where("coalesce(command, '') <> ''")
    out = S.last_outputs(events).select("session_id", "call_id", F.col("exit_code").alias("code"), F.col("kind").alias("out_kind"))
    j = c.join(out, ["session_id", "call_id"], "left")
    return j.select("session_id", F.col("id").alias("event_id"), "ts", "command", "kind", F.col("code").alias("exit_code"), F.when(F.col("out_kind").isNull(), "unknown").otherwise(outcome(F.col("out_kind"), F.col("code"))).alias("outcome"))


def per_session(events: DataFrame, contents: DataFrame) -> DataFrame:
    """One row per session: what its evidence document counts, its task and its final response."""
    e = events.join(contents.select(F.col("id").alias("content_id"), "text", "diff"), "content_id", "left").withColumns({"text": F.coalesce("text", F.lit("")), "diff": F.coalesce("diff", F.lit(""))})
    ok = F.col("duplicate_of").isNull()
    asked = ok & (F.col("role") == "user") & F.col("kind").isin("message", "user_correction") & (F.col("text") != "")
    answered = ok & (F.col("role") == "assistant") & (F.col("kind") == "message") & (F.col("text") != "")
    out = e.groupBy("session_id").agg(
        F.count(F.when(asked, 1)).alias("user_inputs"), F.count(F.when(asked & (F.col("kind") == "user_correction"), 1)).alias("corrections"),
        F.count(F.when(ok & F.col("kind").isin("error", "test_failure"), 1)).alias("errors"), F.count(F.when(ok & (F.col("kind") == "file_operation") & (F.col("diff") != ""), 1)).alias("diffs"),
        F.count(F.when(~ok, 1)).alias("duplicate_events"),
        F.min(F.when(asked, F.struct(*S.ORDER, "text")))["text"].alias("task"), F.max(F.when(answered, F.struct(*S.ORDER, "text")))["text"].alias("final_response"))
    c = commands(events, contents).groupBy("session_id").agg(F.count("*").alias("commands"), F.count(F.when(F.col("outcome") == "failure", 1)).alias("failed_commands"))
    zero = F.lit(0).cast("long")
    return out.join(c, "session_id", "left").withColumns({n: F.coalesce(n, zero) for n in ("commands", "failed_commands")})
