"""The shared folder in which lineage is cut and streams leave their tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or the context names. In local mode, where driver and executors are one process, one is made; on a cluster one must be named."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return context.getCheckpointDir().rstrip("/")
