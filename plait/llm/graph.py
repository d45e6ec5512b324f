"""Connected components of a graph that never leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plait.llm import common


def _starred(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """One star step on edges (u, v): all neighbours are hung on the smallest one.

    Large: of every node, the larger neighbours; small: of every node, the smaller ones and itself. The minima are written
    before the join, so that both of its sides are shuffles and Spark splits the partition of a node with many edges.
    """
    ends = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = common.written(ends.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), f"{name}-least")
    met = ends.join(least, F.col("u") == F.col("w"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    out = common.written(out.where("u <> v").distinct(), name)
    common.dropped(least)
    return out


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root of every node of edges (u, v): the smallest node of its component, by alternating large and small stars.

    Each round is a written table; it ends when a round changes nothing, after some logarithm of the longest path.
    """
    now = common.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    count = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
    state = count(now)
    while state[0]:
        large = _starred(now, True, name)
        new = _starred(large, False, name)
        common.dropped(now, large)
        now, before, state = new, state, count(new)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
