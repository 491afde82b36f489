"""Connected components of links, by alternating large and small stars; every step is a join or an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """(a, b), b < a: every neighbour of a node is tied to the smallest node around it.

    The smallest nodes are written out first: both sides of the join are then plain shuffles, which adaptive execution
    can split where one node has very many neighbours.
    """
    ways = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        ways = ways.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = materialize(ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "star-low")
    tied = ways.join(low, "u")
    if large:
        out = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node of its component.

    links: columns a and b, in any order; loops and repeats do no harm; no links give no rows.
    """
    now = materialize(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    sign = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    was = now.agg(sign).first()[0]
    while was[0]:
        now = materialize(_stars(materialize(_stars(now, True), "large-stars"), False), "small-stars")
        new = now.agg(sign).first()[0]
        if new == was:
            break
        was = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
