"""Checkpoints and written tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of our own in local mode, an error elsewhere."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    if not found:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        found = "file://" + tempfile.mkdtemp(prefix="quillgraph-", dir="/tmp/checkpoints")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Log:
    """A written table that rounds add rows to, each round in one commit."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.schema = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", None

    def add(self, df: DataFrame) -> None:
        self.schema = self.schema or df.schema
        df.write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder: what reads it scans the columns it needs, and Spark knows its size."""
    log = Log(df.sparkSession, name)
    log.add(df)
    return log.read()
