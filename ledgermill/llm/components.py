"""Connected components of a table of links, without bringing them together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.common import BROADCAST_ROWS, shuffled, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first())


#: A node with over this share of all links is hot: there can't be more than BROADCAST_ROWS such nodes.
HOT_SHARE = 2 / BROADCAST_ROWS


def _with_least(edges: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """edges with `m`, the least of `u`, from least (u, m, n). Links of hot nodes stay where they are: their few rows of least are broadcast."""
    hot = F.col("n") > max(1000, HOT_SHARE * links)
    few = F.broadcast(least.where(hot).select("u", F.col("m").alias("hot_m")))
    there = edges.join(few, "u", "left")
    own = least.where(~hot).select("u", "m")
    rest = there.where("hot_m is null").select("u", "v").join(shuffled(own) if links > BROADCAST_ROWS else own, "u")
    return there.where("hot_m is not null").select("u", "v", F.col("hot_m").alias("m")).unionByName(rest)


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")))
    return _with_least(both, least, links).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them. edges: u > v."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    moved = _with_least(edges, least, links).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node that is not the root itself. edges: columns u and v (numbers)."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    edges = stored(edges)
    before = _state(edges)
    while True:
        larger = stored(_large_star(edges, before[0]))
        edges = stored(_small_star(larger, before[0] * 2), larger, edges)
        after = _state(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
