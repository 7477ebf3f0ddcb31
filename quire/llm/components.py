"""Connected components of a graph too large for the driver: alternating large-star and small-star steps.

Each step keeps the components and brings every node nearer to the least node of its own. A node's least neighbour is an
aggregate (partial before the shuffle); the join back to the edges is one that adaptive execution can split at a hub.
Every round is written to the shared folder, so that the lineage stays short and a lost executor costs one round. The
rounds end by themselves, after a number that grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written

def large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links each node, and its smaller neighbours, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, least) for every node of edges (u, v), longs without nulls; loops and repetitions are allowed."""
    edges = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        after = written(small_star(large_star(edges)), "edges")
        # done when the stars stand: no node with two parents and none that is both parent and child
        parents = after.groupBy("u").agg(F.count("*").alias("n"))
        if not parents.where("n > 1").limit(1).count() and not after.join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return after.select(F.col("u").alias("node"), F.col("v").alias("least"))
        edges = after
