"""Streams over folders of files, and running one to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lotscope.plans.lineage import new_folder


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table of a folder as a stream; ``files_per_batch`` limits the rate."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def folder_stream(spark: SparkSession, folder: str, schema, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Exactly-once append to a parquet folder until the input is drained. Input that arrives later is picked up by
    calling this again with the same folders."""
    run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Hand every micro-batch to ``sink(rows, batch_id)`` until the input is drained."""
    run = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint) \
        .outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()


def drained(stream: DataFrame) -> DataFrame:
    """The rows a stream has emitted once its present input is used up, as a table in the shared folder."""
    spark = stream.sparkSession
    path = new_folder(spark, "stream")
    append_to(stream, path, new_folder(spark, "stream-state"))
    return spark.read.schema(stream.schema).parquet(path)
