"""Tables that cut lineage: written to the folder all executors share, so that loops survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir. Only a local session may leave that unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.gettempdir()}/graphloom-scratch"
    return f"{shared.rstrip('/')}/graphloom/{spark.sparkContext.applicationId}"


def durable(df: DataFrame, name: str = "round") -> DataFrame:
    """Write a table to the shared folder and read it back."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(*frames: DataFrame) -> None:
    """Delete tables that durable() wrote and that nothing reads any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            _delete(df.sparkSession, file.rpartition("/")[0])


def release_all(spark: SparkSession) -> None:
    """Delete every table that this application wrote; results that were not yet read or stored are lost with them."""
    _delete(spark, scratch_dir(spark))
