"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for each node of edges (src, dst).

    Each round ties every node's larger neighbours to its least neighbour, then its
    smaller ones; the number of rounds grows with the logarithm of a component's size. All
    steps are group-by minima and joins, so no task ever holds one node's neighbours.
    """
    edges = stage(edges.where("src <> dst").select("src", "dst"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # staged, so that the joins are plain shuffled ones, which Spark can split at a node with many links
        least = stage(both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m")))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = stage(large.where("src <> dst").distinct())
        # now every link runs from a node to a smaller one
        lower = stage(large.groupBy("src").agg(F.min("dst").alias("m")))
        small = large.join(lower, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")
        edges, done = stage(small.unionByName(lower.select("src", F.col("m").alias("dst"))).distinct()), edges
        discard(done, least, large, lower)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    least = edges.groupBy("src").agg(F.min("dst").alias("root"))
    tops = least.select(F.col("root").alias("src"), "root").distinct()
    return least.unionByName(tops).distinct().select(F.col("src").alias("node"), "root")
