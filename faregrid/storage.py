"""Shared storage for intermediate tables.

Intermediates that several jobs read are written as Parquet to the folder the
cluster names in ``spark.checkpoint.dir``, which every executor can reach. That
cuts lineage, survives lost executors and keeps column pruning and pushdown,
which an RDD checkpoint would not.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediates; a temporary one only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    if not _local_fallback:
        _local_fallback.append(tempfile.mkdtemp(prefix="faregrid-"))
    return _local_fallback[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/faregrid/{app}/{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)


def newest(spark: SparkSession, folder: str, key: str, below: int | None = None) -> int:
    """The largest number (under ``below``) among the finished folders ``key=number``, -1 without any."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    where = path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return -1
    found = [s.getPath() for s in files.listStatus(where) if s.getPath().getName().startswith(f"{key}=")]
    numbers = [int(x.getName().split("=")[1]) for x in found if files.exists(path(x, "_SUCCESS"))]
    return max((n for n in numbers if below is None or n < below), default=-1)
