"""Connected components by alternating large-star and small-star rounds; each round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of u moves to the least of u and its neighbours; small: u and its smaller ones do."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, tag: str) -> DataFrame:
    """edges(a, b) of any ordered type, a <> b, to (node, component), the component being its least node."""
    edges = written(edges.select("a", "b"), tag)
    state = None
    while True:
        edges = written(_star(_star(edges, True), False), tag)
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        state = found
