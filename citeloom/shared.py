"""The folder that driver and executors share, and what is cut there."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; a new local one only where driver and executors are one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not named:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir is not set: the cluster has no known shared folder")
            named = tempfile.mkdtemp(prefix="citeloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named or current


def cut(df: DataFrame) -> DataFrame:
    """df as it is now, checkpointed: computed once, and read again after a loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
