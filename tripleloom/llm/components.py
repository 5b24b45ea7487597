"""Connected components by alternating large-star and small-star steps, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b; any order, repeats and loops allowed); root is the
    component's smallest node. No edges: no rows.

    Each round points every node at the smallest of its neighbours, so that paths halve; rounds grow with the logarithm
    of the longest path. Minima are pre-aggregated before the shuffle and hub nodes are left to the
    skew join, so no node's neighbours are gathered anywhere. Rounds are cut by checkpoint()."""
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # large star: all larger neighbours of a node are pointed at its smallest neighbour
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).withColumn("m", F.least("n", "m"))
        now = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = now.filter("a <> b").distinct()
        # small star: all smaller neighbours of a node, and itself, are pointed at the smallest of them
        least = now.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        pairs = now.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = saved(pairs.union(least.select("n", "m")).filter("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = state
