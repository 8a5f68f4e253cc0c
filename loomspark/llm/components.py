"""Connected components of an edge table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the undirected edges (a, b): root is the
    smallest node that can be reached.

    Alternates large-star and small-star steps until nothing changes, a number
    of rounds logarithmic in the largest component. Every step is a partial
    aggregation and a sort-merge join, whose skewed partitions (a node of very
    many edges) adaptive execution splits; the table never grows beyond its
    edges. Each round is written to the shared folder and the one before it
    deleted, so the plan stays short.
    """
    # (u, v) with u > v
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).hint("merge")
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        low = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(low.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        dropped(e, large)
        e = new
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
