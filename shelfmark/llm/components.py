"""Connected components by contraction, with joins and partially aggregated minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node of the edges a, b.

    Each round sends every node to its least neighbour and contracts the edges; rounds are stored, and the roots are
    handed back through them. With nodes in a scrambled order the number of rounds grows as a logarithm.
    """
    edges = stored(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(
            both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("to")), "hooks"
        )
        rounds.append(to)
        left, right = to.toDF("a", "to_a"), to.toDF("b", "to_b")
        moved = edges.join(left, "a").join(right, "b").filter("to_a != to_b")
        edges = stored(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    roots = rounds.pop().withColumnRenamed("to", "root")
    while rounds:
        after = roots.withColumnRenamed("node", "to")
        roots = rounds.pop().join(after, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return stored(roots, "roots")
