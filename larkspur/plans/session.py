"""Session settings under which the plans are meant to run."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution picks partition counts and splits skewed joins; times are UTC, as results must not depend on a machine.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Where scratch tables and checkpoints go in local mode; a cluster names a folder that all executors share.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/larkspur"


def session(master: str | None = None, app: str = "larkspur", **settings: str) -> SparkSession:
    """A session with SETTINGS; settings override them (with _ for . in their names)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    own = {"spark.checkpoint.dir": LOCAL_CHECKPOINTS} if master and master.startswith("local") and not master.startswith("local-cluster") else {}
    for key, value in (SETTINGS | own | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
