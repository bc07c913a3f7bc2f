"""Connected components of a table of edges, by repeated contraction to stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomefold.llm.common import stored

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long); the root is the smallest node.

    Each round links the neighbours of every node, and the node itself, to the smallest of
    them; the edges stay in proportion to the nodes, and the rounds grow with the logarithm
    of a component's length.  A node with very many edges is pre-aggregated on the map side
    and its rows of the join back can be split by the engine.  Nothing reaches the driver
    but a count and a checksum.
    """
    star = stored(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        seen = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == before:
            return _rooted(star)
        before = seen
        both = star.select("a", "b").union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join back has a shuffle of its own whose large keys can be split
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        near = both.join(least, "a").select(F.col("b").alias("x"), "m")
        own = least.select(F.col("a").alias("x"), "m")
        star = stored(near.union(own).where(F.col("x") > F.col("m")).select(
            F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _rooted(star: DataFrame) -> DataFrame:
    leaves = star.groupBy("a").agg(F.min("b").alias("root"))
    roots = star.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return leaves.select(F.col("a").alias("node"), "root").union(roots)
