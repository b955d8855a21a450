"""Connected components of a table of links, by alternating star steps.

Each round hangs every node's larger neighbours on its least one, then its smaller ones; the number
of rounds grows with the logarithm of the longest path. A step is an aggregation and a join on plain
tables, so that Spark can split a node with very many links; nothing is gathered in lists or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour."""
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = stored(both, "neighbours")
    least = stored(_least(both).select("a", F.least("a", "m").alias("m")), "least")
    hung = both.join(least, "a")
    if large:
        hung = hung.where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        hung = hung.select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    pairs = hung.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    return stored(pairs.groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b"), "star")


def components(links: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node of ``links`` (u, v)."""
    edges = stored(links.where("u != v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "links")
    while not edges.isEmpty():
        # Done when all edges hang on roots and no node has two.
        roots = edges.select("b").distinct()
        if edges.join(roots.withColumnRenamed("b", "a"), "a", "left_semi").isEmpty() and edges.groupBy("a").count().where("count > 1").isEmpty():
            break
        edges = _star(_star(edges, True), False)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
