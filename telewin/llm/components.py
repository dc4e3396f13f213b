"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import written


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _centers(near: DataFrame) -> DataFrame:
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    return least.select(F.col("u").alias("c"), F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the least of its neighbourhood."""
    near = _both(links)
    tied = near.join(_centers(near), F.col("u") == F.col("c")).where("v > u")
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are tied to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).where("v <> m")
    tied = others.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(links: DataFrame) -> tuple:
    """Two equal marks mean the same set of links (up to chance)."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame) -> DataFrame:
    """``u``, ``root``: the least node reachable from each node that has a link.

    ``links`` has columns ``u`` and ``v``, long. Loops, repeated links and links
    given in both directions change nothing; no links give no rows. Only
    counts and check sums reach the driver; every step is written to the shared folder.
    """
    now = written(links.where("u <> v").select("u", "v").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        now = written(_small_star(_large_star(now)), "links")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    return now.select("u", F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    )
