"""Incremental ingestion of relationships: a stream of files appended to a relationship table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest_relationships(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append new Parquet files of (id, src, dst, ...) to a table, each batch once: a rerun of a batch overwrites its own folder."""
    stream = spark.readStream.schema(schema).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
