"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the edges, the component being its smallest node.

    Each step is one aggregation with map-side combining and one join, which adaptive execution splits at hot nodes, and
    ends in a stored table; the number of rounds grows with the logarithm of the largest component. Loops are ignored,
    but their nodes are returned."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = pairs.where(F.col("u") == F.col("v")).select("u").distinct()
    loops = materialize(nodes, "loops")
    now = materialize(pairs.where(F.col("u") > F.col("v")).distinct(), "edges")
    while True:
        # large star: every larger neighbour of a node is joined to the smallest node around it
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(materialize(least, "least"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where(F.col("u") != F.col("v")).distinct(), "large")
        # small star: the smaller neighbours of a node, and itself, are joined to the smallest of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = materialize(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        # done when all are stars: no node is below two, or both a centre and below another
        split = new.groupBy("u").count().where("count > 1").select("u").limit(1)
        if not split.union(new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u").limit(1)).count():
            break
        now = new
    centres = new.select(F.col("v").alias("node")).distinct()
    found = new.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres.select("node", F.col("node").alias("component")))
    alone = loops.select(F.col("u").alias("node")).join(found.select("node"), "node", "left_anti")
    return found.union(alone.select("node", F.col("node").alias("component")))
