"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect every node's greater (large) or smaller-or-equal (small) neighbours to the least of its neighbourhood."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # written before the join, so that Spark can split a node with very many neighbours
    least = written(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("m")))
    joined = both.join(least, both["a"] == least["_a"])
    out = joined.where(F.col("b") > F.col("a") if large else F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's least node.

    Each round is two aggregations and joins over the edges and ends in a written table; the number of rounds grows
    with the logarithm of the longest path. Only a count and a checksum reach the driver. Repeated edges and edges from a node to
    itself change nothing (a node with the latter alone isn't in the result), nor do edges with a null; no edges give no rows.
    """
    with Scratch(edges.sparkSession) as scope:
        out = _rounds(edges)
        scope.keep(out)
    return out


def _rounds(edges: DataFrame) -> DataFrame:
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b and a is not null and b is not null").distinct())
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, before = mark, now
        now = written(_star(written(_star(now, True)), False))
        discard(before)
