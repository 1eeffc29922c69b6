"""Where jobs may write intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`.

    Unset, a new local folder will do where driver and executors are one process; on a cluster it
    is an error, as each machine would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="pageloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the shared folder; Spark creates it on first write."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
