"""Connected components by alternating large-star and small-star steps.

Every step is a minimum by key, combined before the shuffle, and an equi-join, so
a vertex with very many edges is neither gathered nor collected; each round is
written to the shared folder, so a lost executor never repeats earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm import shared


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` but the roots themselves; nodes of any type with an order.

    ``root`` is the smallest node that edges reach.  Loops and null ends count for
    nothing, repeated edges once; no edges give no rows.
    """
    edge = shared.materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(edge)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A least neighbour below both ends keeps its own edge; u itself is kept through its neighbour's turn.
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = shared.materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _mark(after)
        shared.drop_scratch(edge)
        edge = after
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return edge.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edge: DataFrame) -> tuple:
    return tuple(edge.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
