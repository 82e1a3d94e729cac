"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset and driver and executors are one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quartzite-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, safe against lost executors.

    small: the rows are few for the partitions that make them; Spark gathers them by size after the work is done.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.hint("rebalance") if small else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
