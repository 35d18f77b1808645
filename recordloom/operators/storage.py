"""Cutting lineage in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    One is set here only where the session has none and driver and executors are one process.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "/tmp/recordloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def write_through(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what is read survives the loss of any executor."""
    at = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
