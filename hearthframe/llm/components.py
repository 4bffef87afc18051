"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthframe.operators.joins import HOT, join_hot
from hearthframe.staging import drop_stage, stage


def _large_star(edges: DataFrame, hot: float) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node around it; nodes with more than hot of these are joined apart."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("times")).where("times > 0")
    moved = join_hot(both.where("v > u"), least.withColumn("m", F.least("u", "m")), "u", "times", hot)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, hot: float) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of them; nodes with more than hot of these are joined apart."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times"))
    moved = join_hot(down, least, "u", "times", hot).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in edges (u, v): the component is its smallest node.

    Self-links, repeated links and either direction are allowed; an empty table gives an empty one.
    Rounds grow with the logarithm of the longest chain. Hubs are never gathered, and joined by
    broadcasting the least neighbour of each, so none of them is one task.
    """
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark, hot = seen, seen[0] * HOT
        large = stage(_large_star(now, hot), "links")
        drop_stage(now)
        now = stage(_small_star(large, hot), "links")
        drop_stage(large)
    return nodes.join(now, nodes.node == now.u, "left").select("node", F.coalesce("v", "node").alias("component"))
