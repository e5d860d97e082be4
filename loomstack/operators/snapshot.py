"""Differences between what is stored and what is there: files by hash, logs by their state; and the incremental index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(stored: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change) with change one of added, removed, updated, unchanged."""
    a = stored.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_was"))
    b = current.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_is"))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def source_plan(sources: DataFrame, discovered: DataFrame) -> DataFrame:
    """(logical_id, plan) of every log known or there.

    'unchanged' if size and time agree, 'extend' if the same file has grown, 'rebuild' if it is another or shorter one, 'new', or
    'missing' for known logs that are gone. Repeated discoveries of a log count once.
    """
    d = discovered.groupBy("logical_id").agg(F.max(F.struct("mtime_ns", "size", "file_id")).alias("d")).select("logical_id", F.col("d.size").alias("_size"), F.col("d.mtime_ns").alias("_mtime"), F.col("d.file_id").alias("_file"), F.lit(True).alias("_is"))
    s = sources.select("logical_id", "size", "mtime_ns", "file_id", F.lit(True).alias("_was"))
    plan = (F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "missing").when((F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime")), "unchanged")
            .when(F.col("file_id").eqNullSafe(F.col("_file")) & (F.col("_size") > F.col("size")), "extend").otherwise("rebuild"))
    return s.join(d, "logical_id", "full_outer").select("logical_id", plan.alias("plan"))


def refreshed(index: DataFrame, changes: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """The index after a change: rows of removed and updated files go, those of added and updated ones come from ``fresh``."""
    gone = changes.where("change in ('removed', 'updated')").select(key)
    come = changes.where("change in ('added', 'updated')").select(key)
    return index.join(gone, key, "left_anti").unionByName(fresh.join(come, key, "left_semi"))
