"""Problem 7: at-least-once deliveries collapse to one row per identifier.

Hash-bucketed sorted storage with idempotent upserts. An upsert of a batch collapses it by identifier (partial aggregation before the
shuffle, so that a hot identifier costs one row per map task), then writes one sorted run: a bucketed table with one file per bucket,
sorted by identifier inside. Writing the same batch again replaces its own run and nothing else. ``compact`` merges two runs at a time by a
full outer join on the identifier: both sides lie in the same buckets and in the same order, so the plan is a bare merge of sorted files
without exchange or sort, equal identifiers meet in it and collapse, and the merged run is written back in the place of the two. Runs
merge in a balanced way, so a row is rewritten as often as the logarithm of the number of runs. The surplus rows are those of the
deliveries whose id is not a survivor: an anti join on the unique row id, which no hot identifier can skew.

Identifier: (session_id, part_ordinal, native_event_id trimmed and in lower case). Of its rows the highest ``version`` survives, among
equal versions (retries, redeliveries) the lowest ``id``; without versions all are equal. Defined results: rows with a null or blank native
id, a null session or a null part are never surplus and always kept; a null version is the lowest; repeated rows with the same id count
once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.functions.scalars import folded
from loomstack.runtime import hadoop_fs, scratch

KEY = ("session_id", "part_ordinal", "native_id")
#: Deliveries arrive in so many batches where a query has a whole table to deliver.
BATCHES = 3
_TYPES = {"session_id": "bigint", "part_ordinal": "bigint", "native_id": "string", "age": "bigint", "id": "bigint", "gone": "boolean"}
_ORDERING = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def keyed(events: DataFrame, version: Column | None = None, deleted: Column | None = None) -> DataFrame:
    """The rows that carry an identifier: KEY, ``age`` (the lower, the later the version), ``id`` and ``gone``."""
    age = F.lit(0) if version is None else -F.coalesce(version.cast("long"), F.lit(-(2**62)))
    return (
        events.select("id", F.col("session_id").cast("long").alias("session_id"), F.col("part_ordinal").cast("long").alias("part_ordinal"), folded(F.col("native_event_id")).alias("native_id"),
                      age.cast("long").alias("age"), F.coalesce(deleted, F.lit(False)).alias("gone") if deleted is not None else F.lit(False).alias("gone"))
        .where("native_id <> '' and session_id is not null and part_ordinal is not null and id is not null")
    )


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    """A session setting for the planning of what runs inside."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, was) if was is not None else spark.conf.unset(name)


class BucketedStore:
    """Sorted runs in hash buckets under one folder, one folder per run."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _write(self, rows: DataFrame, run: str) -> None:
        """One file per bucket, sorted, and a mark when all are there."""
        name = self._name(run)
        self.spark.sql(f"drop table if exists {name}")
        self._remove(run)
        rows.write.format("parquet").mode("overwrite").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/run={run}").saveAsTable(name)

    def _name(self, run: str) -> str:
        return "run_" + hashlib.sha256(f"{self.path}\0{run}".encode()).hexdigest()[:24]

    def _remove(self, run: str) -> None:
        fs, at = hadoop_fs(self.spark, f"{self.path}/run={run}")
        fs.delete(at, True)

    def upsert(self, rows: DataFrame, batch: str) -> None:
        """Add a batch of keyed rows; idempotent by ``batch``."""
        one = rows.groupBy(*KEY).agg(F.min(F.struct("age", "id", "gone")).alias("s")).select(*KEY, "s.*")
        # The buckets of the table are the partitions of the aggregation.
        self._write(one.repartition(self.buckets, *KEY), batch)

    def runs(self) -> list[str]:
        """Names of the complete runs."""
        fs, at = hadoop_fs(self.spark, self.path)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(n.removeprefix("run=") for n in names if n.startswith("run=") and fs.exists(hadoop_fs(self.spark, f"{self.path}/{n}/_SUCCESS")[1]))

    def run(self, name: str) -> DataFrame:
        """One run, with its buckets and order known to the planner."""
        t = self._name(name)
        if not self.spark.catalog.tableExists(t):
            columns = ", ".join(f"{c} {k}" for c, k in _TYPES.items())
            keys = ", ".join(KEY)
            self.spark.sql(f"create table {t} ({columns}) using parquet clustered by ({keys}) sorted by ({keys}) into {self.buckets} buckets location '{self.path}/run={name}'")
        return self.spark.table(t)

    def merged(self, a: str, b: str) -> DataFrame:
        """Two runs as one: a merge of their sorted buckets, equal identifiers collapsed."""
        row = lambda t: F.when(F.col(f"{t}.id").isNotNull(), F.struct(f"{t}.age", f"{t}.id", f"{t}.gone"))
        left, right = self.run(a).alias("a"), self.run(b).alias("b")
        on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEY]
        j = left.hint("merge").join(right, on, "full_outer")
        return j.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in KEY], F.least(row("a"), row("b")).alias("s")).select(*KEY, "s.*")

    def compact(self) -> DataFrame:
        """Merge all runs into one, written back: one row per identifier.

        A merged run takes its name from the two that it replaces, which go only when it is complete; a compaction that dies and is
        started again finds either them or it, and merging the same rows twice changes nothing.
        """
        with _setting(self.spark, _ORDERING, "true"):
            queue = self.runs()
            while len(queue) > 1:
                a, b, *queue = queue
                both = hashlib.sha256(f"{a}\0{b}".encode()).hexdigest()[:16]
                self._write(self.merged(a, b), both)
                for old in (a, b):
                    self.spark.sql(f"drop table if exists {self._name(old)}")
                    self._remove(old)
                queue.append(both)
        columns = ", ".join(f"{c} {k}" for c, k in _TYPES.items())
        return self.run(queue[0]) if queue else self.spark.createDataFrame([], columns)


def survivors(events: DataFrame, path: str | None = None, version: Column | None = None, deleted: Column | None = None) -> DataFrame:
    """Identifiers with the row that stays, through the bucketed store: KEY, ``age``, ``id``, ``gone``.

    The rows arrive in BATCHES batches by the log that delivered them (by their id where there is no such column).
    """
    spark = events.sparkSession
    store = BucketedStore(spark, path or scratch(spark, "dedup"))
    by = F.pmod(F.xxhash64("source_id" if "source_id" in events.columns else "id"), F.lit(BATCHES))
    for k in range(BATCHES):
        store.upsert(keyed(events.where(by == k), version, deleted), str(k))
    return store.compact()


def surplus(events: DataFrame) -> DataFrame:
    """(event_id) of the rows that an earlier row of the same identifier makes superfluous."""
    stay = survivors(events).select("id")
    return keyed(events).select("id").distinct().join(stay, "id", "left_anti").select(F.col("id").alias("event_id"))


def deduplicated(events: DataFrame) -> DataFrame:
    """``events`` without the surplus rows; all columns kept."""
    return events.join(surplus(events).withColumnRenamed("event_id", "id"), "id", "left_anti")


def folded_versions(events: DataFrame, version: Column | None = None, deleted: Column | None = None) -> DataFrame:
    """``events`` as they stand after all creates, edits, deletes and retries: the last version of each identifier, none if that deletes it.

    Rows without an identifier have just the one version.
    """
    if version is None and deleted is None:
        return deduplicated(events)
    stay = survivors(events, version=version, deleted=deleted).where("not gone").select("id")
    with_key = keyed(events, version, deleted).select("id").distinct()
    lost = with_key.join(stay, "id", "left_anti")
    kept = events.join(lost, "id", "left_anti")
    if deleted is not None:
        kept = kept.where(~F.coalesce(deleted, F.lit(False)) | (F.col("id").isNull()))
    return kept
