"""A folder that driver and executors share, for queries that write files and read them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def staging(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a temporary one only under a local master."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomtext-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/loomtext/{name}-{uuid.uuid4().hex}"
