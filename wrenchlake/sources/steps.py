"""Intermediate tables, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir.  In local mode a temporary folder takes its place; on a cluster that would be a
    folder of one machine, so there the setting must not be missing."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input dealt out over all cores, which a file of one row group would keep to one of them.  An input that
    gives each core a whole partition or a file of its own, or more, stays as it is: there the shuffle would cost more than it brings."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    whole = spark._jvm.org.apache.spark.sql.internal.SQLConf.get().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * whole and len(df.inputFiles()) < cores else df


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes a step as Parquet and reads it back: it is computed once however often it is read, its plan ends here, and a lost
    executor costs no more than its running tasks."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
