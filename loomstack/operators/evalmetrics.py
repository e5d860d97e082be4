"""Relevance metrics of ranked results: success and coverage at k, reciprocal ranks, and what a reader reads until the first good hit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_task(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(task, first_rank, rr, lines_read, success_k, coverage_k ...). ``ranked``: (task, rank, path, lines); ``gold``: (task, path)."""
    g = gold.select("task", "path").distinct()
    n = g.groupBy("task").agg(F.count("*").alias("gold"))
    r = ranked.join(g.withColumn("good", F.lit(1)), ["task", "path"], "left").withColumn("good", F.coalesce("good", F.lit(0)))
    w = Window.partitionBy("task").orderBy("rank")  # the results of one task: limited
    r = r.withColumn("_before", F.coalesce(F.max("good").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    agg = r.groupBy("task").agg(
        F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first_rank"), F.sum(F.when(F.col("_before") == 0, F.col("lines")).otherwise(0)).alias("lines_read"),
        *[F.count_distinct(F.when((F.col("good") == 1) & (F.col("rank") <= k), F.col("path"))).alias(f"_hit_{k}") for k in ks])
    return n.join(agg, "task", "left").select(
        "task", "first_rank", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("rr"), F.coalesce("lines_read", F.lit(0)).alias("lines_read"),
        *[F.coalesce((F.col(f"_hit_{k}") > 0).cast("int"), F.lit(0)).alias(f"success_{k}") for k in ks], *[F.coalesce(F.col(f"_hit_{k}") / F.col("gold"), F.lit(0.0)).alias(f"coverage_{k}") for k in ks])


def overall(tasks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    return tasks.agg(
        F.count("*").alias("tasks"), F.count("first_rank").alias("tasks_hit"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("first_rank"), 6).alias("avg_first_rank"), F.sum("lines_read").alias("lines_read"),
        *[F.round(F.avg(f"{m}_{k}"), 6).alias(f"{m}_{k}") for m in ("success", "coverage") for k in ks])
