"""Connected components of links by alternating large and small stars.

Every round is grouping and joining: a node with a million neighbours is one minimum per task, and, as the minima are
kept before they are joined, a join that Spark can split. Links stay in the cluster; the driver sees
whether any node still needs a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch, scratch, stored


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one root at most and no root hangs on another."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty()


def _stars(own: Scratch, links: DataFrame, a: str, b: str) -> DataFrame:
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    links = own.keep(links.where(F.col(a) != F.col(b)).select(u, v).distinct(), "links")
    while not _are_stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = own.keep(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w")), "least")
        large = own.keep(both.where("v > u").join(least, "u").where("v != w").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct(), "large")
        fewer = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(fewer, "u").where("v != w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        merged = own.keep(small.unionByName(fewer.withColumnRenamed("w", "v")).distinct(), "links")
        own.drop(links, least, large)
        links = merged
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def components(links: DataFrame, a: str = "a", b: str = "b", within: Scratch | None = None) -> DataFrame:
    """(node, component) of each node that has a link; component is its smallest node. Links to itself say nothing.

    The result lies among the tables of within, if given, and goes with them.
    """
    if within:
        return _stars(within, links, a, b)
    with scratch(links.sparkSession, "components") as own:
        return stored(_stars(own, links, a, b), "components")
