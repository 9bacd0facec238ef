"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import discard, materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)``; a component is named by its smallest node.

    Alternates large-star and small-star contraction: each node's edges are moved to its
    smallest neighbour until they no longer change. Only minima are kept for a node, never
    a list of its neighbours. Each round is written to the shared folder, so that a lost
    executor costs one round at most. The number of rounds grows with the logarithm of the
    number of nodes. Nulls and loops are ignored; an empty table gives no rows.
    """
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    now, seen = materialise(now, "edges"), None

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    for _ in range(max_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # Small star: of each node's smaller neighbours, all and the node itself move to the smallest.
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        kept = large.join(lower, "b")
        small = kept.select(F.col("m").alias("x"), F.col("a").alias("y")).union(lower.select("m", "b"))
        before, now = now, materialise(small.where("x < y").distinct().toDF("a", "b"), "edges")
        discard(before)
        after = mark(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError("components did not settle")
    label = now.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    return label.union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
