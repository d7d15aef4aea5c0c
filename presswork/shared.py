"""The folder that all executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; on one machine, where it is unset, a folder below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints").rstrip("/")
