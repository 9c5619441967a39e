"""The folder that all executors share, for tables that are written and read again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``; only a local master may do without that setting."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), f"shiftscope-{uuid.uuid4().hex}")
        spark.sparkContext.setCheckpointDir(where)
    return f"{where.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def kept(frame: DataFrame) -> DataFrame:
    """The rows once worked out, in the shared folder: what reads them several times reads these."""
    path = work_folder(frame.sparkSession, "kept")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
