"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the same key; its result is stored in the shared folder, so a lost executor costs
one step at most.  Only two numbers a round, the count and a checksum of the links, reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (``a``, ``b`` bigint, any order): the root is the smallest node reachable.

    Links from a node to itself, repeated links and links with a null end count nothing.
    """
    a, b = F.col("a"), F.col("b")
    held = cut_lineage(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = None
    while before != (now := _sum(held)):
        before = now
        both = held.union(held.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        large = cut_lineage(large)
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        over = large.join(smallest, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        held = cut_lineage(over.union(smallest.select("a", F.col("m").alias("b"))).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a != b).distinct())
    roots = held.select(a.alias("node"), b.alias("root"))
    return roots.union(held.select(b.alias("node"), b.alias("root")).distinct())
