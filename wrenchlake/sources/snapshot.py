"""Versioned snapshots of a table: publish unless it is suspiciously small, keep the one before, recover when local is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MIN_ROWS = 10


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it does not exist."""
    fs, where, _ = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions (with a _SUCCESS file), oldest first."""
    fs, where, jvm = _folder(spark, path)
    done = [n for n in names(spark, path) if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(where, f"{n}/_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


def drop_version(spark: SparkSession, path: str, version: int) -> None:
    fs, where, jvm = _folder(spark, path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(where, f"v={version}"), True)


def publish_snapshot(df: DataFrame, path: str, min_rows: int = MIN_ROWS) -> int | None:
    """Writes the next version and drops all but the last two; returns its number, or None if the table is too small."""
    spark = df.sparkSession
    if df.limit(min_rows).count() < min_rows:
        return None
    have = versions(spark, path)
    new = (have[-1] if have else 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/v={new}")
    for old in have[:-1]:
        drop_version(spark, path, old)
    return new


def recover_snapshot(local: DataFrame, path: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """``local`` if it has ``min_rows`` rows; else the last published version, unless that has fewer rows than max(local, 1)."""
    spark = local.sparkSession
    n = local.limit(min_rows).count()
    have = versions(spark, path)
    if n >= min_rows or not have:
        return local
    kept = spark.read.schema(local.schema).parquet(f"{path}/v={have[-1]}")
    need = max(n, 1)
    return kept if kept.limit(need).count() >= need else local
