"""Tables that are computed once and read back from the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

from candor.sources.tables import spread_over_cores


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a folder of its own only in local mode."""
    local = spark.sparkContext.master.startswith("local")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not local:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="candor-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not local and _file_system(spark, folder).getScheme() == "file":
        warnings.warn(f"{folder} must be mounted on all machines", stacklevel=2)
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's file system closes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _file_system(spark, path).deleteOnExit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    return path


def stage(
    df: DataFrame, name: str, partition_by: str | None = None, spread: bool = False
) -> DataFrame:
    """Write the table to a fresh path in the shared folder and read it back.

    It then has a known size, so that Spark broadcasts it in joins if it is small, and a
    lost executor costs a re-read.  ``spread`` is for rows that take long to work on: a
    small table would come back in few splits, as Spark packs small files together.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    return spread_over_cores(staged) if spread else staged
