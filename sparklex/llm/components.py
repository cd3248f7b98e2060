"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.llm.scratch import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least of it and its neighbours; edges go from larger to smaller, before and after."""
    up = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = edges.unionByName(up).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return up.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of these; edges go from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return moved.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether each node is linked to one smaller node at most, and to none if larger ones are linked to it."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("least"), F.col("b").alias("most")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("least"), F.col("b").alias("most")))
    return ends.groupBy("node").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches) of each node in links (a, b, of one sortable type).

    Nodes without links aren't in the result; links of a node with itself, and nulls, are left out. What returns to the
    driver in each round is whether all is stars. Each step is written before the next one reads it, and the result, too: the
    driver then plans a few shuffles at a time, not those of all the steps that would be read again in one plan.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", narrow=True)
    while not _stars(edges):
        large = written(_large_star(edges), "large-star", narrow=True)
        dropped(edges)
        edges = written(_small_star(large).distinct(), "links", narrow=True)
        dropped(large)
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = written(ends.unionByName(roots), "components", narrow=True)
    dropped(edges)
    return found
