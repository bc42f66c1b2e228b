"""Intermediate tables and connected components, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.steps import stored

__all__ = ["are_stars", "components", "stored"]

#: A node is hot if it has more than this share of all links; there are at most twice its inverse of them.
HOT_SHARE = 1 / 64


def are_stars(link: DataFrame) -> bool:
    """Whether every node of links (u, v) either hangs on one other node or has others hang on it: components are then final."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")), F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))))
    each = link.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.hangs").alias("hangs"), F.max("e.holds").alias("holds"))
    return each.where("hangs > 1 OR hangs = 1 AND holds = 1").isEmpty()


def with_least(links: DataFrame, own: DataFrame) -> DataFrame:
    """Adds to links (u, v) the smallest node m that ``own`` (u, m, n) has for u; n: how many links u has.

    Links of hot nodes, of which there can be no more than 2 / HOT_SHARE, get it by a broadcast and stay where they are; the
    others are joined."""
    own = stored(own, "own")
    hot = F.broadcast(own.where(F.col("n") > HOT_SHARE * own.agg(F.sum("n")).first()[0]).select("u", "m"))
    rest = links.join(hot.select("u"), "u", "left_anti").join(own.select("u", "m"), "u")
    return links.join(hot, "u").select("u", "v", "m").union(rest.select("u", "v", "m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond"), which
    need a number of rounds logarithmic in the diameter.  Each round only groups and joins; hot nodes are combined on the map
    side and joined without a shuffle (``with_least``); the driver only learns whether stars are left.
    """
    link = stored(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct(), "links")
    while not are_stars(link):
        both = link.select("u", "v").union(link.select(F.col("v").alias("u"), F.col("u").alias("v")))
        own = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = stored(with_least(both, own).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        own = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = with_least(large, own).select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        link = stored(small, "links")
    roots = link.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return link.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
