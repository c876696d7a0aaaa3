"""Connected components over edge tables, by alternating large-star and small-star rounds.

Every round is two grouped minima and joins, so no node's neighbours ever meet in
one task: minima are combined before the shuffle, and the joins' larger side, whose
keys may be hot, is split by adaptive execution, since the other side has one row a
key. Each round's edges are checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.session import cut

MAX_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node go to the least of its neighbourhood."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below go to the least of these. a > b throughout."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """node, root: every node of edges (a, b) that isn't the least of its component, with that least node.

    Nulls and loops are left out; repeated edges and either direction are fine.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, seen = cut(current), None
    for _ in range(max_rounds):
        mark = current.agg(F.count("*").alias("n"), F.sum((F.xxhash64("a", "b") % (1 << 40))).alias("h")).first()
        if mark["n"] == 0 or (mark["n"], mark["h"]) == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = (mark["n"], mark["h"])
        current = cut(_small_star(_large_star(current).distinct()).distinct())
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")
