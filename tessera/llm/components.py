"""Distributed connected components by alternating large-star and small-star contraction.

Every step is a map-side combined ``groupBy(min)`` and a join on the node, so the neighbours of a node never
meet in one task: a hub is summed where its edges lie, and its smallest neighbour is sent to them (``hub_join``). Each round
is written to the shared folder. Only a count and a checksum of the edges reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hub_join, materialise


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Link every neighbour that is larger (or, small star, not larger) than a node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("n"))
    met = hub_join(both, low, "a", "n", total)
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``edges`` (a long, b long), either direction, repeats, loops and nulls allowed -> (node, component).

    ``component`` is the smallest node reachable. Nodes that have no edge to another node are not returned;
    an empty table gives an empty table.
    """
    now = materialise(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    sign = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    before = now.agg(sign.alias("s")).first()["s"]
    for _ in range(max_rounds):
        now = materialise(_star(materialise(_star(now, True, 2 * before["n"]), "large"), False, before["n"]), "star")
        after = now.agg(sign.alias("s")).first()["s"]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
