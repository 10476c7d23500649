"""Tables between the steps of a job, and the batches that Spark hands to its tasks."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame

from lotscope.llm.words import BATCH_BYTES

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark) -> None:
    """Let Spark hand batches of about two slices to Python, whatever the size of a row; a session that names a size keeps it.

    By default a batch has ten thousand rows or 64 MiB, which the JVM holds while it writes them and a worker while it
    cuts them, once a running task each.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(2 * BATCH_BYTES))


def through_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet to a path in the shared folder and read it back.

    This cuts the lineage: later steps survive lost executors without repeating this one. The shuffle files of the step
    are of no more use; collecting garbage on the driver lets Spark delete them now rather than at some later time. What
    Python no longer holds leaves the JVM with the next call into it, so the table is opened before.
    """
    spark = df.sparkSession
    df.write.parquet(path)
    del df
    gc.collect()
    made = spark.read.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return made


def drop_table(spark, path: str) -> None:
    """Delete a table of the job that no later step reads."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
