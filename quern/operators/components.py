"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that can reach a smaller one; root is the smallest it can reach.

    edges: a, b of one type that can be ordered; loops and repeated edges don't matter. Each round hooks every node to its smallest
    neighbour, follows two parents, and contracts the edges, so rounds grow with the logarithm of the longest path.
    All steps are joins and combinable minima; a node with very many edges is no group. Rounds are written to the shared folder.
    """
    left = written(_ordered(edges.select("a", "b")), "edges")
    rounds = []
    while not left.isEmpty():
        up = left.groupBy("a").agg(F.min("b").alias("p"))
        for _ in range(2):
            up = up.join(up.select(F.col("a").alias("k"), F.col("p").alias("q")), F.col("p") == F.col("k"), "left").select("a", F.coalesce("q", "p").alias("p"))
        up = written(up, "parents")
        rounds.append(up)
        of = lambda k, p: up.select(F.col("a").alias(k), F.col("p").alias(p))  # noqa: E731, B023
        moved = left.join(of("ka", "pa"), F.col("a") == F.col("ka")).join(of("kb", "pb"), F.col("b") == F.col("kb"), "left")
        unfinished = up.join(of("k", "q"), F.col("p") == F.col("k")).select(F.col("p").alias("a"), F.col("q").alias("b"))
        left = written(_ordered(moved.select(F.col("pa").alias("a"), F.coalesce("pb", "b").alias("b")).unionAll(unfinished)), "edges")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    done = rounds[-1].select("a", F.col("p").alias("root"))
    for up in reversed(rounds[:-1]):
        later = done.select(F.col("a").alias("k"), F.col("root").alias("r"))
        done = up.join(later, F.col("p") == F.col("k"), "left").select("a", F.coalesce("r", "p").alias("root")).unionAll(done).groupBy("a").agg(F.min("root").alias("root"))
    return done.select(F.col("a").alias("node"), "root")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
