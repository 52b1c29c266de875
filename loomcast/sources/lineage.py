"""Cutting lineage through tables in the cluster's shared folder.

Written Parquet survives the loss of executors, is columnar, and lets later
stages prune columns; it replaces row-format checkpoints for multi-pass jobs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by `spark.checkpoint.dir`; where it is unset, one below the warehouse folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lineage"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once, read back: one computation however many consumers follow."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
