"""Connected components of an edge table, without collecting any part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.session import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b): the smallest node of each component.

    Large-star and small-star steps alternate until nothing changes; the number of
    rounds grows with the logarithm of the longest path. The smallest neighbour of a
    node is a partial aggregate, so a node with very many neighbours is no hot spot.
    """
    now = checkpointed(edges.select("a", "b").where("a != b").distinct())
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(low.select("a", F.col("m").alias("b"))).distinct()
        now = checkpointed(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
