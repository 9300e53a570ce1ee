"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one ordered type); root is the smallest node reachable.

    Large-star and small-star alternate until the edges are stars around the smallest node of each component: a number
    of rounds that grows with the logarithm of the longest chain. Edges are written once per round, every step is
    an equi-join or an aggregation, and no component is gathered in one task. A hub has as many edges as its
    component has nodes; its minimum is stored by itself, so that the join to it has two plain shuffles as inputs, which
    adaptive execution splits where they are skewed.
    """
    edges = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while True:
        # Large star: every larger neighbour of a node is linked to the smallest node around.
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        large = stored(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        after = stored(small, "small")
        # A fixed point is a set of stars: every node has one smaller neighbour, which has none.
        moving = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
        chained = after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
        edges = after
        if moving.unionByName(chained).isEmpty():
            break
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
