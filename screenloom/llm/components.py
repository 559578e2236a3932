"""Connected components by alternating large-star and small-star contraction.

Every round is two aggregations and two equi-joins over the edge table; a node of very many
edges is pre-aggregated before the shuffle and its join side can be split by adaptive execution.
One number (a test for stars) reaches the driver. Each round ends in a written table, which is read
in as many tasks as its size asks for, however many wrote it. The number of rounds grows with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, root): the smallest node reachable; nodes without edges are absent."""
    stars = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _all_stars(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        # a neighbour and the node itself both go to the least neighbour; rows of one node stand together, so most repeats end before the exchange
        small = large.join(lowest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        stars = written(small.filter("u <> v").distinct())
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down to a node that has none; distinct (u, v) with v < u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.filter("down > 1 OR down + up > 1").isEmpty()
