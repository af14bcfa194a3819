"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._common import discard, join_skewed, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: the neighbours of each node (larger ones, or smaller ones and itself) move to its smallest neighbour.

    Minima are pre-aggregated where the edges lie.  A node with very many neighbours is never gathered in
    one task: its minimum is broadcast to its edges (`join_skewed`).
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = join_skewed(both, least, ["a"])
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _resting(edges: DataFrame) -> bool:
    """Whether the edges are stars already: no node has two larger ends or is both end and centre."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("end"), F.lit(0).alias("centre")).union(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("x").agg(F.sum("end").alias("ends"), F.max("centre").alias("centre"))
    return seen.where("ends > 1 OR (ends > 0 AND centre > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node that has an edge; edges: a, b (long).  label is the smallest node of the component.

    Self-loops, repeated edges and nulls don't matter.  Every step is written to the shared scratch
    folder, and the one before it deleted; the number of rounds follows the logarithm of the longest path.
    Centres of stars are the smallest nodes of their components, as every step moves ends to smaller nodes.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(now, "edges")
    while not _resting(now):
        for large in (True, False):
            before, now = now, materialise(_star(now, large), "edges")
            discard(before)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
