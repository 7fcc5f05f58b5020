"""Folders that all machines of a cluster see, and tables written there to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares, removed when Spark ends; a local run has one of its own."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not shared and context._jsc.sc().getCheckpointDir().isDefined():
        shared = context._jsc.sc().getCheckpointDir().get()
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        shared = tempfile.gettempdir() + "/orrery-scratch"
    path = f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The frame written as Parquet in a shared folder and read again, which cuts its lineage."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
