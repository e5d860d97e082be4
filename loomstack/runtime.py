"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
#: Paths of written tables that are not removed yet.
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Open one Parquet table; only the named columns when given, so that the scan is pruned early."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before work that is heavy per row, if the scan came in fewer partitions than there are cores.

    A table of many files already has more, and then nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) is a folder of our own created, and removed at exit. On a
    cluster without the setting this is an error: a folder of one machine would hold tables that the others cannot read.
    """
    global _own_dir
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="loomstack-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    sc.setCheckpointDir(f"file://{_own_dir}")
    return f"file://{_own_dir}"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table in the shared folder; ``release`` removes it."""
    path = f"{shared_dir(spark)}/loomstack/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove the written tables of this process, once no result that reads them is needed any more; returns their number."""
    n = len(_made)
    while _made:
        fs, at = hadoop_fs(spark, _made.pop())
        fs.delete(at, True)
    return n


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A lost executor then costs the reading of some files, not the recomputation of the whole plan.
    """
    path = scratch(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_fs(spark: SparkSession, path: str):
    """(file system, path object) for whatever scheme the shared folder has."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def local_session(name: str = "loomstack", cores: str | None = None) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.driver.memory", os.environ.get("LOOMSTACK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
