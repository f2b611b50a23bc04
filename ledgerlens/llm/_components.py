"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._util import stored


def _join_min(edges: DataFrame, floor_self: bool) -> DataFrame:
    """Edges ``(u, v)`` with ``m``: the smallest neighbour of ``u`` (and ``u`` itself)."""
    low = F.min("v")
    mins = edges.groupBy("u").agg((F.least("u", low) if floor_self else low).alias("m"))
    return edges.join(mins, "u")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the component's smallest node.

    Each round hangs all larger neighbours of a node under its smallest one
    (large star), then the smaller ones under the smallest of them (small
    star).  Minima are pre-aggregated before their shuffle, and a node with
    very many edges sits on one side of a sort-merge join that Spark may split.
    Rounds grow with the logarithm of the longest path.  Only a row count and a
    checksum of each round's table reach the driver.
    """
    both = edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, seen = stored(both, "cc-edges"), None
    while True:
        either = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _join_min(either, True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _join_min(large.distinct(), False)
        following = small.select("u", F.col("m").alias("v")).unionByName(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        current = stored(following, "cc-edges")
        state = tuple(current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
