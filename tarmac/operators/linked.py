"""Linked sets of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.session import stage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node in `edges` (a, b: long): root is the smallest node it is linked to.

    Alternates large-star and small-star steps, each an aggregation and a join, so nothing but the
    count of unfinished links reaches the driver. Every round is written to the shared folder.
    """
    e = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    for _ in range(rounds):
        roots = e.select(F.col("b").alias("a")).distinct()
        shared = e.groupBy("a").count().where("count > 1").select("a")
        if roots.join(e.select("a").distinct(), "a", "left_semi").isEmpty() and shared.isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("a", "a"))
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        e = e.where("a <> b")
        e = stage(e)
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = (
            e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).distinct()
        )
        e = stage(e)
    raise RuntimeError(f"links not resolved in {rounds} rounds")
