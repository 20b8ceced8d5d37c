"""Where intermediate tables go: a folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def workspace(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset and the master is
    local, a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="stratum-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/workspace"
