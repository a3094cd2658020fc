"""Folders that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from larkspur.plans.session import LOCAL_CHECKPOINTS


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, or, in local mode without that setting, under LOCAL_CHECKPOINTS."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL_CHECKPOINTS
    return f"{base.rstrip('/')}/larkspur/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
