"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node in links(u, v); component is the smallest node reachable.

    Links may repeat, stand in either direction or join a node with itself. Each round is two
    aggregations with map-side minima and two equi-joins, whose hot side AQE can split; lineage
    is cut after each round, and the number of rounds grows with the logarithm of the nodes.
    Nothing but a row count and a hash reaches the driver.
    """
    e = cut(links.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct())
    before = _state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(low, "a")
        small = pairs.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b")
        e = cut(small.distinct())
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(out.select("component").distinct().select(F.col("component").alias("node"), "component"))
