"""The chunk table: partitioned by a bucket of the document, replaced document by document, version by version.

A write puts new chunks into a folder of its own and then publishes a version: a small table that names, for each bucket, the writes
that hold it.  Only a bucket that holds a re-indexed document, or has ``FAN`` writes, is written anew as a whole; to the others new
documents are added.  Readers follow the last published version, so they see a write whole or
not at all, whatever becomes of it; the folders of the version before stay for readers that have begun.  Nothing is overwritten
that a version names, and what a failed write left behind is overwritten by the next.  One writer at a time.

    path/data/w=<write>/bucket=<bucket>/...     chunks
    path/versions/v=<write>                     (bucket, w) of each bucket and write; the row of bucket -1 holds (buckets, batch)
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshot import drop_version, versions
from .steps import stored
from .tables import schema

#: A bucket is what one changed document rewrites; a file is what one task writes.
ROWS_PER_BUCKET = 1_000_000
ROWS_PER_FILE = 250_000
MOST_BUCKETS = 65_536
#: Writes that hold a part of a bucket before they become one.
FAN = 16
#: So many full buckets are written by the tasks that have their rows, without a shuffle by bucket.
AS_THEY_ARE = 64
MANIFEST = "bucket int, w long, buckets int, batch long"


def bucket_of(buckets: int, document_id: str = "document_id"):
    """By the hash that shuffles by document go by, so that a task after such a shuffle holds few buckets."""
    return F.pmod(F.hash(document_id), F.lit(buckets)).cast("int")


def replace_chunks(existing: DataFrame, new: DataFrame, reindexed: DataFrame) -> DataFrame:
    """The table after re-indexing: chunks of the re-indexed documents give way to the new ones."""
    return existing.join(reindexed.select("document_id").distinct(), "document_id", "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


class Folder:
    """A folder in whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.where = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.where)] if self.fs.exists(self.where) else []

    def drop(self, name: str) -> None:
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(self.where, name), True)


class Version:
    """A published version: its number, how many buckets the table has, the batch that it came from, and where buckets are."""

    def __init__(self, spark: SparkSession, path: str, number: int):
        self.number, self.rows = number, spark.read.schema(MANIFEST).parquet(f"{path}/versions/v={number}")
        meta = self.rows.where("bucket = -1").first()
        self.buckets, self.batch = meta.buckets, meta.batch
        self.places = self.rows.where("bucket >= 0").select("bucket", "w")

    def writes(self) -> list[int]:
        """The writes that hold a part of it; at most ``FAN`` for each bucket."""
        return sorted(r.w for r in self.places.select("w").distinct().collect())


def current(spark: SparkSession, path: str) -> Version | None:
    have = versions(spark, f"{path}/versions")
    return Version(spark, path, have[-1]) if have else None


def generations(spark: SparkSession, path: str) -> list[int]:
    """The number of buckets of the table, if there is one."""
    now = current(spark, path)
    return [now.buckets] if now else []


def chunks_of(spark: SparkSession, path: str, version: Version) -> DataFrame | None:
    """The chunks of a version, with their bucket; None if it has none.  Only folders that it names are listed, and buckets that
    a later write has replaced are pruned."""
    folders = [f"{path}/data/w={w}" for w in version.writes()]
    if not folders:
        return None
    rows = spark.read.option("basePath", f"{path}/data").parquet(*folders).withColumn("w", F.col("w").cast("long"))
    return rows.join(version.places, ["bucket", "w"], "left_semi").select(*[c for c in rows.columns if c not in ("bucket", "w")], "bucket")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of the last published version, with their bucket."""
    rows = chunks_of(spark, path, current(spark, path))
    return spark.createDataFrame([], schema("doc_chunks").add("bucket", "integer")) if rows is None else rows


def put(spark: SparkSession, rows: DataFrame, path: str, number: int) -> None:
    """Writes rows as folder w=number, each bucket as several files if it is large.

    Small buckets are gathered first.  Large ones are not, unless they are many: shuffling them once more would cost as much as
    writing them, and what a task has of a bucket is a file of its own."""
    whole, touched = rows.agg(F.count("*"), F.count_distinct("bucket")).first()
    each = whole / max(1, touched)
    if each < ROWS_PER_FILE or touched > AS_THEY_ARE:
        rows = rows.repartition("bucket", F.pmod(F.xxhash64("document_id", F.lit(1)), F.lit(max(1, math.ceil(each / ROWS_PER_FILE)))))
    rows.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("bucket").parquet(f"{path}/data/w={number}")


def publish(spark: SparkSession, path: str, number: int, places: DataFrame, buckets: int, batch: int | None) -> None:
    """Makes a version readable, which its _SUCCESS file does, and drops what the last two versions do not name."""
    meta = spark.createDataFrame([(-1, None, buckets, batch)], MANIFEST)
    none = F.lit(None)
    rows = places.select("bucket", "w", none.cast("int").alias("buckets"), none.cast("long").alias("batch")).unionByName(meta)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/v={number}")
    have = versions(spark, f"{path}/versions")
    for old in have[:-2]:
        drop_version(spark, f"{path}/versions", old)
    named = {w for v in have[-2:] for w in Version(spark, path, v).writes()}
    data = Folder(spark, f"{path}/data")
    for name in data.names():
        if name.startswith("w=") and int(name[2:]) not in named:
            data.drop(name)


def held_by(spark: SparkSession, path: str, number: int) -> DataFrame:
    """(bucket, w) of the buckets that a write has put down."""
    names = Folder(spark, f"{path}/data/w={number}").names()
    return spark.createDataFrame([(int(n[7:]), number) for n in names if n.startswith("bucket=")], "bucket int, w long")


def write_chunks(spark: SparkSession, new: DataFrame, reindexed: DataFrame, path: str, buckets: int | None = None, batch: int | None = None) -> bool:
    """Index sink: adds chunks, and rewrites only the buckets that hold a re-indexed document, as one version.

    The number of buckets follows the table's size (``ROWS_PER_BUCKET``), unless it is given: a table that has outgrown its
    buckets fourfold is dealt out anew, as a version too.  ``batch``: a number that rises from write to write; a write whose
    number the table has reached already does nothing, and returns False.
    """
    now = current(spark, path)
    if now and batch is not None and now.batch is not None and now.batch >= batch:
        return False
    number = (now.number if now else 0) + 1
    if now is None:
        count = buckets or fitting(new.count())
        put(spark, new.withColumn("bucket", bucket_of(count)), path, number)
        publish(spark, path, number, held_by(spark, path, number), count, batch)
    else:
        count = now.buckets
        fresh = new.withColumn("bucket", bucket_of(count))
        ids = stored(reindexed.select("document_id").distinct(), "ids")
        touched = now.places.groupBy("bucket").count().where(F.col("count") >= FAN).select("bucket")
        before = chunks_of(spark, path, now)
        if before is not None:
            held = before.select("document_id", "bucket").distinct().join(ids, "document_id", "left_semi")
            touched = stored(touched.union(held.select("bucket")).distinct(), "touched")
            kept = before.join(touched, "bucket", "left_semi").join(ids, "document_id", "left_anti")
            fresh = kept.select(*fresh.columns).unionByName(fresh)
        put(spark, fresh, path, number)
        places = now.places.join(touched, "bucket", "left_anti").unionByName(held_by(spark, path, number))
        publish(spark, path, number, places, count, now.batch if batch is None else batch)
    whole = chunks_of(spark, path, current(spark, path))
    if now is not None and buckets is None and whole is not None:
        n = whole.count()
        if fitting(n) >= 4 * count:
            put(spark, whole.drop("bucket").withColumn("bucket", bucket_of(fitting(n))), path, number + 1)
            publish(spark, path, number + 1, held_by(spark, path, number + 1), fitting(n), current(spark, path).batch)
    return True


def fitting(n: int) -> int:
    """A power of two that gives buckets of ROWS_PER_BUCKET rows at most."""
    return min(MOST_BUCKETS, 1 << max(0, math.ceil(math.log2(max(n, 1) / ROWS_PER_BUCKET))))
