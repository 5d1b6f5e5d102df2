"""Lineage cuts for iterative plans: through the shared checkpoint folder, never a local one on a cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _own(context) -> str:
    """A folder of our own, removed at the end: only for local[n], where executors are the driver."""
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: executors share no other folder with the driver")
    own = tempfile.mkdtemp(prefix="inkwell-")
    atexit.register(shutil.rmtree, own, True)
    return own


def cut(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        context.setCheckpointDir(_own(context))
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, for tables, streams' checkpoints and commits."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{(shared or 'file://' + _own(spark.sparkContext)).rstrip('/')}/inkwell-{name}-{uuid.uuid4().hex}"
