"""Cutting the lineage of tables that a loop builds on, and folders that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(session: SparkSession) -> str:
    """A new folder's name below the application's own in spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder; a cluster must name one.
    """
    context = session.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
            found = tempfile.mkdtemp(prefix="statloom-")
            atexit.register(shutil.rmtree, found, True)
        context.setCheckpointDir(found)
    return f"{context._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder of spark.checkpoint.dir and read from there, so that it outlives its executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
