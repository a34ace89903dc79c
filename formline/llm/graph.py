"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.session import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, label``: the smallest id reachable from each id of the edges ``a, b``.

    Alternates the large-star and the small-star step until the edges are stars.  Each step is stored, so a lost
    executor repeats one step at most; each is a grouping with one row per neighbour and never a pair of neighbours.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("a").alias("id"), F.col("b").alias("label"))
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").filter("b <> m").select("b", "m").union(least).toDF("a", "b")
        new = stored(small.filter("a <> b").distinct(), "edges")
        # Stars: no centre is a leaf, and no leaf has two centres.
        leaves = new.groupBy("a").count()
        done = leaves.filter("count > 1").isEmpty() and new.join(leaves.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        now = new
        if done:
            centres = now.select(F.col("b").alias("id")).distinct().withColumn("label", F.col("id"))
            return now.select(F.col("a").alias("id"), F.col("b").alias("label")).union(centres)
    raise RuntimeError(f"no stars after {rounds} rounds")
