"""Connected components per group by alternating minima, in few rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup

ROUNDS = 60
BLOCKS = 64


def _minima(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`pairs` with the smallest partner m of each u.

    The minima are spread over (u, block of partners) before they are joined, so a node with
    very many partners is not one task's work.
    """
    low = pairs.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    return lookup(pairs, low, [*keys, "u"], F.pmod(F.xxhash64("v"), F.lit(BLOCKS)))


def components(edges: DataFrame, keys: Sequence[str] = (),
               rounds: list | None = None) -> DataFrame:
    """(keys, node, root) of every node of `edges` (keys, u, v) that has a partner.

    `root` is the smallest node of the component. Each round first points the larger
    partners of a node at its smallest one, then the node and its smaller partners, so that
    long paths are halved; every round is a checkpoint. The list `rounds` gets one entry a
    round.
    """
    keys = list(keys)
    pairs = (edges.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"),
                                          F.least("u", "v").alias("v")).distinct().checkpoint())
    state = None
    for _ in range(ROUNDS):
        both = pairs.unionByName(pairs.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_minima(both, keys).withColumn("m", F.least("u", "m"))
                 .where("v > u and v <> m")
                 .select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _minima(large, keys).select(*keys, F.explode(F.array(
            F.struct("u", F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = small.select(*keys, "e.u", "e.v").where("u <> v").distinct().checkpoint()
        if rounds is not None:
            rounds.append(len(rounds))
        seen = pairs.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(*keys, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(pairs.select(*keys, F.col("u").alias("node"), F.col("v").alias("root")))
