"""Keep an intermediate table that several steps read, so that it is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This session's folder under the one the cluster names for checkpoints.

    Without such a setting only a local session gets a folder, a temporary one; on a cluster executors
    could not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "folder" not in _local:
            _local["folder"] = tempfile.mkdtemp(prefix="craterline-")
        folder = _local["folder"]
    return f"{folder.rstrip('/')}/craterline-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, by: str | None = None) -> DataFrame:
    """The table written to the shared folder, in a folder for each value of ``by`` if given, and read back.

    Lineage ends there, lost executors cost nothing, and the file size lets Spark decide on a
    broadcast from a known bound.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all staged tables of this session; DataFrames that read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
