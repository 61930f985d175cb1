"""Connected components of a link table, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm import storage


def _print(links: DataFrame) -> tuple:
    """Number and order-free hash of the links."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(links: DataFrame) -> DataFrame:
    """``u, m``: the smallest of each node's ``v``, a row for each node. Few rows are broadcast; beyond that the joins with
    it are plain shuffles, whose large partitions Spark splits: one node may have a third of all links."""
    return storage.placed(links.groupBy("u").agg(F.min("v").alias("m")), "least")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a``, ``b``): the smallest node that it is linked to.

    A large star links the greater neighbours of a node to the smallest one, a small star the others and the node
    itself. Alternating, they turn every component into one star in about the logarithm of its diameter rounds.
    No links give no rows; loops and repeated links change nothing.
    """
    now = storage.materialize(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _print(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _least(both)
        # Of each link the greater node moves from the smaller one to that one's smallest neighbour or itself.
        by_small = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(near, "u")
        large = by_small.select(F.col("w").alias("u"), F.least("u", "m").alias("v"))
        if not storage.is_broadcast(near):
            large = storage.materialize(large, "large")
        low = _least(large)
        small = large.join(low, "u")
        pairs = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v").distinct()
        after = storage.materialize(pairs, "links")
        storage.discard(now, near, large, low)
        now, before, seen = after, seen, _print(after)
        if before == seen:
            break
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
