"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sqlcurate.sources.storage import stored


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours of a node move to the smallest of them. Rows do not grow beyond the edges."""
    both = edges.union(edges.select("b", "a").toDF("a", "b")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    joined = both.join(low, "a")
    moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")) if large else joined.select("b", "low").toDF("a", "b").union(low.toDF("a", "b"))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): every node that has a link, with the smallest node that it reaches."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = None
    while True:
        edges = stored(star(star(edges, large=True), large=False), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
        before = state
