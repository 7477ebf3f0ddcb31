"""Connected components of many graphs at once, one for each key, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def components(edges: DataFrame, key: str) -> DataFrame:
    """(key, node, least) for every node of edges (key, u, v), longs: the least node that links lead to.

    Large stars link a node's larger neighbours to the least one, small stars a node and its smaller neighbours; each
    round is written, and they end when every node points at a root. The rounds grow with the logarithm of the longest chain.
    """
    larger = edges.where("u != v").select(key, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(larger, "edges")
    while True:
        both = now.unionByName(now.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(key, "u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        star = both.where("v > u").join(least, [key, "u"]).select(key, F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = star.groupBy(key, "u").agg(F.min("v").alias("m"))
        moved = star.join(least, [key, "u"]).select(key, F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u != v")
        after = written(moved.unionByName(least.select(key, "u", F.col("m").alias("v"))).distinct(), "edges")
        again = after.groupBy(key, "u").count().where("count > 1").limit(1).count()
        if not again and not after.join(after.select(key, F.col("v").alias("u")), [key, "u"], "left_semi").limit(1).count():
            return after.select(key, F.col("u").alias("node"), F.col("v").alias("least"))
        now = after
