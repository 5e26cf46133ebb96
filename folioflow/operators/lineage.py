"""Where work is cut: lineage between passes, rows between tasks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); our own only on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{folder.rstrip('/')}/folioflow/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, spark: SparkSession) -> DataFrame:
    """df cut off from its lineage: written to the shared folder and read again."""
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly to as many tasks as shuffles have, and two for each core at least.

    For maps that take far longer over a row than a shuffle of it, where files or coalesced partitions are too few.
    """
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
