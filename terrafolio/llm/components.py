"""Connected components of a graph that only Spark holds, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafolio.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that links reach) of every node of ``edges`` (a, b).

    Loops, repeats and either direction are fine; nodes without edges aren't listed; no edges give no rows. Each round's
    edges are written to the shared folder. The number of rounds grows with the logarithm of the nodes.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.keep(pairs)
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        # large star: each node's larger neighbours go to the smallest of its neighbourhood
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = scratch.keep(small.where("a <> b").distinct())
        scratch.drop(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.col("m").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
