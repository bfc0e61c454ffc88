"""Connected components of an edge table by alternating large and small stars, over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

HOT_NODES, HOT_DEGREE = 10_000, 200


def star(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """Hook each node's larger (or not larger) neighbours to its smallest neighbour. Only minima are gathered by node.

    A node's minimum goes back to its neighbours by a join; the few nodes of high degree (at most HOT_NODES: 2 * n_edges ends
    are shared out) are broadcast instead, so that no task gets all neighbours of one node.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.union(both.select("v", "u")) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    most = max(HOT_DEGREE, 2 * n_edges // HOT_NODES)
    least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"), "degree"), "least")
    hot = least.where(f"degree > {most}").select(F.col("k").alias("hot_k"), F.col("m").alias("hot_m"))
    looked = both.join(F.broadcast(hot), F.col("u") == F.col("hot_k"), "left")
    rest = looked.where("hot_k is null").select("u", "v").join(least.where(f"degree <= {most}"), F.col("u") == F.col("k"))
    joined = looked.where("hot_k is not null").select("u", "v", F.col("hot_m").alias("m")).union(rest.select("u", "v", "m"))
    hooked = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    out = written(hooked.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    forget(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs). node, component: its smallest connected node, for every node that has an edge to a smaller one."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    digest = lambda e: tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).head())
    before = digest(now)
    while True:
        grown = star(now, True, before[0])
        forget(now)
        now = star(grown, False, before[0])
        forget(grown)
        after = digest(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after
