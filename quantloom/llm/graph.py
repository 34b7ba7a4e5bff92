"""Connected components of links between documents, as joins and aggregates over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def _starred(edges: DataFrame) -> bool:
    """Whether every node with smaller neighbours has a single one, which has none itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("lower"), F.lit(0).alias("higher")).union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("lower").alias("lower"), F.max("higher").alias("higher"))
    return ends.where("lower > 1 or lower = 1 and higher = 1").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node that is reachable, for every node of edges (a, b).

    Large-star and small-star steps in turn (each node's larger, then smaller neighbours are linked to its smallest one)
    until each component is a star; the number of turns grows with the logarithm of a component's size. Stars that are
    given take no turn: add links to labels that are known, not to the links these came from. Neighbours are never
    gathered in a list: the smallest is an aggregate with map-side combining, and the rest are rows of a join.
    """
    scratch = Scratch(edges.sparkSession)
    edges = scratch.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0")
    turn = 0
    while not _starred(edges):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")  # a row for each edge at most
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        turn += 1
        edges = scratch.written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"edges{turn}")
        scratch.drop(f"edges{turn - 1}")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())
