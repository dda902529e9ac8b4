"""Connected components by alternating large and small stars, over written tables.

Each round joins every node with its smallest neighbour and hangs its other neighbours there; the
links stay a set of pairs, so no group is ever gathered, and diameter halves or better a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.scratch import written

MAX_ROUNDS = 100


def connected(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of `links` (two columns, any order)."""
    a, b = links.columns
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = written(pairs, "links")
    before = None
    for _ in range(MAX_ROUNDS):
        # Large star: greater neighbours of a node move to its smallest neighbour or itself.
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: smaller neighbours of a node, and the node, move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        told = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if told == before:
            break
        before = told
    else:
        raise RuntimeError("components did not settle")
    # Settled links are stars: every node but the centre points at it.
    centres = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
