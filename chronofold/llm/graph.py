"""Connected components of a graph of links, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import saved


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links(a, b); nulls and self links are ignored.

    Large-star and small-star steps in turn (Kiveris et al., 2014): each points a node's neighbours to the smallest of
    them. Minima are grouped with partial aggregation and joined back, so that no node's neighbours meet in one task's
    memory. Each round is written to the shared folder; the number of rounds grows with the log of the longest chain.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = saved(small.distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
