"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """The session's spark.checkpoint.dir; a fresh local folder only where none is set and driver and executors are one process (tests)."""
    key = "spark.checkpoint.dir"
    at = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        at = getattr(spark.sparkContext, "_regionpairs_dir", None)
        if at is None:
            at = spark.sparkContext._regionpairs_dir = tempfile.mkdtemp(prefix="spark-")
    return at.rstrip("/")


def through_table(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
