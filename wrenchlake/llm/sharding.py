"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled by a seeded digest within each source and ranked; rank r (from 0) of n rows becomes the fraction
(r + 1/2) / n; all rows are put in the order of their fractions and cut into shards whose counts differ by one at most.  Each
shard is then a slice of every source, so it matches the corpus' mixture.  The law is ``rows``.

Ranks are found without a window over a whole source: rows fall into fine ranges of the digest (of the fraction), a row's
rank is the rows in earlier ranges plus its rank within its own range.  There are enough ranges to hold about ``PER_RANGE``
rows each; only exactly repeated rows share a digest.

Defined results: a null source is a source of its own; null text has size 1 and the checksum of no bytes; repeated rows each
take a slot; fewer rows than shards leave the last shards empty; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

SHARDS = 8
SEED = "shards-1"
PER_RANGE = 2_000
MAX_RANGES = 1 << 16


def digest(seed: str) -> Column:
    """64 hexadecimal digits that depend on the seed, doc_id and text."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("|", F.lit(seed), part("doc_id"), F.md5(part("text").cast("binary"))).cast("binary"), 256)


def ranked(rows: DataFrame, by: list[str], place: Column, order: list[str], n_ranges: int, out: str) -> DataFrame:
    """Adds the row's rank (from 0) within ``by``; ``place`` in [0, 1) never falls along ``order``."""
    rows = rows.withColumn("_range", F.least(F.floor(place * n_ranges).cast("int"), F.lit(n_ranges - 1)))
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.select(*by, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")), "ranges")
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_range")]
    joined = rows.withColumn("_own", own).alias("a").join(counts.alias("b"), same).select("a.*", "b._before")
    return joined.withColumn(out, F.col("_before") + F.col("_own") - 1).drop("_before", "_own", "_range")


def shards(docs: DataFrame, n_shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        digest(seed).alias("digest"),
    )
    rows = stored(rows, "rows")
    total = rows.count()
    n_ranges = min(MAX_RANGES, total // PER_RANGE + 1)
    place = F.conv(F.substr("digest", F.lit(1), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    totals = stored(rows.groupBy("source").agg(F.count("*").alias("n")), "totals").alias("t")
    rows = ranked(rows, ["source"], place, ["digest", "doc_id"], n_ranges, "r").alias("a")
    rows = rows.join(totals, F.col("a.source").eqNullSafe(F.col("t.source"))).select("a.*", ((F.col("r") + 0.5) / F.col("n")).alias("fraction"))
    rows = ranked(stored(rows, "fractions"), [], F.col("fraction"), ["fraction", "source", "digest", "doc_id"], n_ranges, "at")
    shard = F.floor(F.col("at") * n_shards / max(total, 1)).cast("int")
    first = F.ceil(F.col("shard").cast("long") * F.lit(total) / n_shards).cast("long")
    return rows.withColumn("shard", shard).select("doc_id", "source", "size", "text_crc32", "shard", (F.col("at") - first).alias("slot"))


def op10_stratified_sharding(spark, sf_dir: str) -> DataFrame:
    out = shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
