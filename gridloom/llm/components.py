"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import cut, drop_cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: link each node's neighbours (the larger or the smaller ones) to the least of them all.

    The minimum is a partial aggregate; the join back to the edges can be split where a hub is hot.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = both.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    own = least.where("m != a").select("a", F.col("m").alias("b"))
    return joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label): for each node of the undirected edges (a, b) the smallest node it reaches."""
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        after = cut(_star(_star(now, True), False))
        drop_cut(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
        state = seen
