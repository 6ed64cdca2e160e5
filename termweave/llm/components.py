"""Connected components of a graph given as pairs of longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.tables import written


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of `pairs` (columns a, b); nodes share a root exactly if a
    path joins them.

    Every round points each node at its least neighbour, follows the pointers once more,
    replaces the ends of all pairs by what they point at, and drops pairs that have become
    loops, so the graph shrinks until no pair is left. The least neighbour is a minimum, taken
    in every task first, so a node that has a third of all pairs costs a row per task; the
    joins have a unique side and a side of plain rows, which adaptive execution splits.
    """
    edges = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .where("a < b").distinct())
    steps = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
            "node", F.least("node", "near").alias("to"))
        # A local minimum points at itself, so the pointers form trees; one jump halves them.
        least = written(least)
        jump = least.select(F.col("node").alias("to"), F.col("to").alias("far"))
        moved = written(least.join(jump, "to").select("node", F.col("far").alias("to")))
        steps.append(moved)
        ends = (edges.join(moved.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
                .join(moved.select(F.col("node").alias("b"), F.col("to").alias("y")), "b"))
        edges = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                        .where("a < b").distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots
