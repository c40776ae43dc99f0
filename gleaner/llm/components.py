"""Connected components of an edge table, by alternating large-star and small-star steps.

Every round is a partial-aggregated minimum for each node and one join on it; AQE splits the join where a node holds
many edges. Each round is written to the shared folder, so its lineage is short and lost executors cost one round.
No component, and no edge list, is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Link a node's neighbours to the smallest node around it: the larger ones (large) or the smaller ones and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sided = both if large else both.filter("v < u")
    least = sided.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sided.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: for every node of an edge table (u, v) its smallest reachable node; roots point at themselves."""
    current = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = None
    while True:
        current = written(star(star(current, True), False), "star")
        total = current.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(total) == sign:
            break
        sign = tuple(total)
    # At rest every edge is (node, root); a node has one.
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
