"""Append-only tables of partial results, merged in tiers.

Each micro-batch appends one folder.  When a tier has ``FAN`` folders they become one folder of the next tier, so a row is
written once for each tier (a logarithm of the number of batches) and what a batch writes does not grow with the table.

    path/tier=<t>/v=<batch>      the batches since the folder before, up to this one

A folder counts once its _SUCCESS file is there, and no longer once a higher tier has reached its batch; so neither a failed
write nor a failed merge changes what readers see, and a batch that is already in is not written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .snapshot import drop_version, names, versions

FAN = 16


def live(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(tier, batch) of the folders that count, oldest first."""
    kept, reached = [], -1
    for t in sorted((int(n[5:]) for n in names(spark, path) if n.startswith("tier=")), reverse=True):
        mine = [v for v in versions(spark, f"{path}/tier={t}") if v > reached]
        kept += [(t, v) for v in mine]
        reached = max([reached, *mine])
    return kept


def read_all(spark: SparkSession, path: str, folders: list[tuple[int, int]] | None = None) -> DataFrame | None:
    """The rows of the folders that count (or of those given), without tier and batch; None if there are none."""
    folders = live(spark, path) if folders is None else folders
    return spark.read.parquet(*[f"{path}/tier={t}/v={v}" for t, v in folders]) if folders else None


def append(rows: DataFrame, path: str, number: int, merge: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """Adds the rows of batch ``number`` and merges tiers that are full with ``merge``."""
    spark = rows.sparkSession
    have = live(spark, path)
    if not have or have[-1][1] < number:
        rows.write.mode("overwrite").parquet(f"{path}/tier=0/v={number}")
    tier = 0
    while len(full := [f for f in live(spark, path) if f[0] == tier]) >= FAN:
        merge(read_all(spark, path, full)).write.mode("overwrite").parquet(f"{path}/tier={tier + 1}/v={full[-1][1]}")
        tier += 1
    for t in range(tier):
        counted = {v for k, v in live(spark, path) if k == t}
        for v in versions(spark, f"{path}/tier={t}"):
            if v not in counted:
                drop_version(spark, f"{path}/tier={t}", v)
