"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, standing_on


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in `edges` (a, b) that isn't its own component.

    Minima are aggregated before the shuffle and joined back, so that a node with very many neighbours is a skewed
    join key, which Spark splits, and never one task's group. Every round is a finished table in the shared folder.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = materialise(edges, "edges")
    while not _settled(edges):
        before, edges = edges, materialise(_small_star(_large_star(edges)).distinct(), "edges")
        discard(before)
    return standing_on(edges.select(F.col("u").alias("id"), F.col("v").alias("component")), edges)


def _settled(edges: DataFrame) -> bool:
    """Whether every node with an edge has one only, to a node without: all components are stars then."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not nodes.filter("out > 1 OR (out = 1 AND into = 1)").limit(1).count()
