"""Connected components by alternating large-star and small-star rounds, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casehours.llm.common import cut, settled


#: Edges of a round whose least neighbours (two numbers a node, and no more nodes than edges) may be broadcast.
BROADCAST_EDGES = 500_000


def _least(pairs: DataFrame, few: bool) -> DataFrame:
    """u and its least v: broadcast if there are few; else written, so that the join with it has plain exchanges and AQE can split a hub."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return F.broadcast(least) if few else cut(least, "least")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, few).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    least = _least(edges, few)
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple[bool, int]:
    """Are the edges stars, that is, has every node one parent at most, and no parent a parent? And the number of edges."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    unfinished, n = nodes.agg(F.max(F.expr("up > 1 or up > 0 and down > 0")), F.sum("up")).first()
    return not unfinished, n or 0


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every end of the edges (u, v); ids that no edge has are left out.

    Every round brings nodes nearer to the smallest id of their component, so the rounds come to an end.
    """
    held = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    while not (state := _state(held))[0]:
        few = state[1] <= BROADCAST_EDGES
        held = settled(lambda now=held, few=few: _small_star(_large_star(now, few) if few else cut(_large_star(now, few), "large-star"), few), "edges")
    return held.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(held.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
