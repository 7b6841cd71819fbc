"""Connected components of a graph of links, by alternating stars.

Every round replaces links by links to smaller neighbours (first over all
neighbours, then over the smaller ones) until each node points at the least
node of its component: O(log n) rounds, each two aggregations with map-side
minima and joins that AQE splits at hubs. Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base


def _least(links: DataFrame) -> DataFrame:
    """(a_, m): the least neighbour of each node. The key is computed anew, so
    that the minima are shuffled for the join that follows: only then can AQE
    split the links of a hub among tasks."""
    return links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").bitwiseXOR(F.lit(0).cast("long")).alias("a_"), F.col("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a_", F.least("a_", "m").alias("m"))
    found = both.join(least, both["a"] == least["a_"])
    return found.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = _least(links)
    found = links.join(least, links["a"] == least["a_"])
    across = found.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return across.union(least.select(F.col("a_").alias("a"), F.col("m").alias("b"))).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def least_reachable(links: DataFrame) -> DataFrame:
    """From links (a, b) of longs: (a, b) with b the least node
    reachable from a, for every linked node but the least ones themselves.
    Loops and repeated links are ignored; no links give an empty table."""
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = base.stored(now, "links"), None
    while (found := _mark(now)) != mark:
        mark = found
        if not found[0]:
            break
        after = base.stored(_small_star(_large_star(now)), "links")
        base.discard(now)
        now = after
    return now
