"""Connected components by alternating large and small stars, in DataFrame operations.

Every round moves the neighbours of a node to the smallest of them; a chain of any length folds
to a star in a number of rounds that grows with its logarithm.  Rounds are written tables in the
shared folder, so a lost executor repeats one round at most.  A node with very many
neighbours is folded by minimum before the shuffle, and its join is split by skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.session import discard, materialize


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the edges (columns a, b): root is the smallest node of its component."""
    links = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, "links")
    before = None
    for _ in range(rounds):
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where(F.col("u") != F.col("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        links, old = materialize(small, "links"), links
        discard(old)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
