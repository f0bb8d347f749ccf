"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

ROUNDS = 40


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """edges: a, b (long; loops allowed). Returns node, component for every node of an edge; component is the least node.

    Nulls are no nodes: an edge with one is left out. Each round is two shuffles of the edges and is written to the shared
    folder, from which the round before is deleted. A hub's edges are never gathered: only the
    least neighbour of each node is found, which sums up before the shuffle, and is joined back to its edges, a join that
    Spark may split where a node is hot. The number of rounds is about the logarithm of the longest path.
    """
    edges = edges.where("a is not null and b is not null")
    graph = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    last = None
    for _ in range(rounds):
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # Large star: every larger neighbour of u is tied to the least of u and its neighbours.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u != v").distinct(), "components")
        # Small star: every smaller neighbour of u, and u, are tied to the least of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        before, graph = graph, written(small.where("u != v").distinct(), "components")
        discard(before)
        discard(large)
        state = graph.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(graph.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
