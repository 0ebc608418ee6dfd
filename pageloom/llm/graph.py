"""Connected components of a table of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. Links point from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _unsettled(edges: DataFrame) -> int:
    """Nodes that still have two roots, or a root that has one itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    ends = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return ends.filter((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))).count()


def components(links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``node`` and ``root``, the least node reachable, for nodes other than roots. ``links``: a, b.

    ``roots`` has what an earlier call found for other links, which then need
    not be gone over again.  Alternates large-star and small-star until each
    node is linked with its root alone.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if roots is not None:
        edges = edges.unionByName(roots.toDF("a", "b"))
    edges = common.written(edges.distinct(), "links")
    while True:
        edges = common.written(_small_star(_large_star(edges)), "links")
        if not _unsettled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
