"""Listing of stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files_under(spark: SparkSession, path: str) -> DataFrame:
    """key, length and modification time of all files under a path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.col("path").alias("key"), "length", "modificationTime")


def list_files(keys: DataFrame, prefix: str = "", max_keys: int = 500) -> DataFrame:
    """The first ``max_keys`` keys under a prefix, in order of key; empty keys and folder markers do not count."""
    key = F.col("key")
    return keys.where(key.startswith(prefix) & (key != "") & ~key.endswith("/")).orderBy("key").limit(max_keys)
