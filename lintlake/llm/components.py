"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    return (
        both.join(least, "a").where("b > a")
        .select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has an edge, the root being its component's smallest node.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type; direction,
    repeats and loops don't matter, and rows with a null are no edges.  Large
    and small stars alternate until nothing changes; the rounds grow with the
    logarithm of the longest path.  Minima are combined before the shuffle, and
    each round is stored in the shared folder.
    """
    edges = stored(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 32)), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state
        edges = stored(_small_star(_large_star(edges)), "edges")
