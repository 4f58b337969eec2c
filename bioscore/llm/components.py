"""Connected components by alternating stars, with every round in a shared table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import lookup
from .shared import written

ROUNDS = 60
BLOCKS = 64


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of `edges` (u, v); root is the smallest of its component.

    Each round points every node at the smallest neighbour seen (first over the larger
    neighbours, then over the smaller ones). Minima are combined before the shuffle and spread
    over (node, block of neighbours) before they are joined, so a node with very many
    neighbours is many tasks' work. The number of rounds grows with the logarithm of the longest
    path. Nodes may be of any type with an order.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"),
                                         F.least("u", "v").alias("v"))
    pairs = written(pairs.distinct(), name)
    state, block = None, F.pmod(F.xxhash64("v"), F.lit(BLOCKS))
    for _ in range(ROUNDS):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (lookup(both, low.select("u", F.least("u", "m").alias("m")), "u", block)
                 .where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup(large, low, "u", block).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = written(small.select("e.u", "e.v").where("u <> v").distinct(), name)
        seen = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.union(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")))
