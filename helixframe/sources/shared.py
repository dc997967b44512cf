"""The folder that executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a folder made for it."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoints-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def keep(df: DataFrame) -> DataFrame:
    """The rows in the shared folder, without the plan that made them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """A kept table, marked for broadcasting if a count proves it to have no more than so many rows; else as it is, for a
    shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
