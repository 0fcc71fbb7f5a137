"""Computing a frame once that later steps read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary one in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veristrata-")
    return f"{base.rstrip('/')}/veristrata/{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written to spark.checkpoint.dir where that is set, else cached."""
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not base:
        return df.cache()
    path = f"{base.rstrip('/')}/veristrata/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
