"""Cutting lineage in iterative jobs through reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The checkpoint folder of the session, set up when a local session has none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("this job needs spark.checkpoint.dir to name a shared folder")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_folder(spark, name: str) -> str:
    """A fresh path in the shared folder for a table a job writes and reads back."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor never replays the loop.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a local session, as in tests, may
    run without it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
