"""Where jobs of the archive keep tables that they write and read again."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; on this machine only where it is unset and all tasks run here."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder}/{name}-{uuid4().hex}"
