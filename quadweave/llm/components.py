"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.llm.shared import forget, written

#: Edges of a node beyond which it may be a hub, and hubs at most.
HUB, HUBS = 100, 100_000


def _both_ways(e: DataFrame) -> DataFrame:
    return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(e: DataFrame, least: DataFrame) -> DataFrame:
    """e with m, the least node around u; least is a written table. Nodes of more than HUB edges, and of more than one in
    HUBS of all, are few enough to be broadcast, so that a hub's edges stay where they are; others are met by a shuffle."""
    most = max(HUB, (least.agg(F.sum("n")).first()[0] or 0) // HUBS)
    hubs = F.broadcast(least.filter(F.col("n") > most).select("u", "m"))  # HUBS rows at most
    at_hubs = e.join(hubs, "u").select("u", "v", "m")
    return at_hubs.union(e.join(hubs, "u", "left_anti").join(least.filter(F.col("n") <= most), "u").select("u", "v", "m"))


def _star(e: DataFrame, least: DataFrame) -> DataFrame:
    return _with_least(e, least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _least(e: DataFrame, m: Column) -> DataFrame:
    return written(e.groupBy("u").agg(m.alias("m"), F.count("*").alias("n")), "least")


def _round(e: DataFrame) -> DataFrame:
    """Large star: each larger neighbour of a node is linked to the least node around it. Small star: a node and its smaller
    neighbours are linked to the least of them; edges go from the larger node u to the smaller v."""
    near = _both_ways(e)
    above = _least(near, F.least(F.min("v"), F.col("u")))
    large = written(_star(near.filter("v > u"), above).filter("u != v").distinct(), "edges")
    below = _least(large, F.min("v"))
    small = _star(large, below).union(below.select("u", F.col("m").alias("v")))
    out = written(small.filter("u != v").distinct(), "edges")
    for spent in (above, large, below):
        forget(spent)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the least node reachable, for every node that has an edge to another one.

    Hubs are joined by broadcast, and there are at most HUBS; minima are combined before they are shuffled. Each
    round is written to the shared folder; only two numbers come to the driver. Null ends and loops are ignored."""
    e = written(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before = now
        after = _round(e)
        forget(e)
        e = after
