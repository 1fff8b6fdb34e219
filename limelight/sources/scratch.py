"""Intermediate tables in the folder shared by all executors.

A plan that reads an intermediate result several times, and must see the same rows each
time, writes it once as Parquet. The folder is the one the cluster names in
`spark.checkpoint.dir`; only a local session without that setting gets a temporary one.
Losing an executor costs nothing that is stored there.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/") + "/limelight"
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = "file:" + tempfile.mkdtemp(prefix="limelight-")
    return _local_roots[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path; whatever is written there is removed when the application ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    fs, target = hadoop_path(spark, path)
    fs.deleteOnExit(target)
    return path


def materialise(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` once and continue from the stored rows; filters on `partition_by` skip whole files."""
    path = scratch_path(df.sparkSession, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system and path objects of `path`."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop_path(spark, path)
    return fs.exists(target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Create or replace one small file."""
    fs, target = hadoop_path(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = hadoop_path(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder, none if it does not exist."""
    fs, target = hadoop_path(spark, path)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def remove(spark: SparkSession, path: str) -> None:
    fs, target = hadoop_path(spark, path)
    fs.delete(target, True)
