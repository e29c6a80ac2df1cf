"""Connected components of a graph of links, by stars that Spark joins build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellers.operators.sizing import splittable_join
from tellers.session import cut


def _large_stars(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    joined = splittable_join(both, least, ["a"], "inner")
    return joined.where("b > a AND b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    tied = splittable_join(down, least, ["a"], "inner").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, least): the least node that each node with a link can reach.

    ``links`` has columns a and b. Large and small stars take turns until nothing
    changes, about as often as the logarithm of the longest path; the edges never
    become more, and each turn is a written table, so a lost executor costs a turn at
    most. A node with many links is split between tasks.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        edges = cut(_small_stars(_large_stars(edges)))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("least")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("least")).distinct()
    )
