"""Connected components of links that are metadata (headers renamed into each other)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.plans.sized import released, written


def components(links: DataFrame) -> DataFrame:
    """(node, least): the least node of the component of every node of ``links`` (a, b), values of any one type that has
    an order. Large and small stars by turns: the number of rounds grows with the logarithm of a path's length, and no
    round has more links than the first."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        after = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        after = written(after)
        same = after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty()
        released(edges)
        edges = after
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("least")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("least")).distinct())
