"""Connected components by alternating large-star and small-star rounds.

Both stars are a grouped minimum (combined before the shuffle) and a join, so
a node with very many neighbours is never gathered in one place.  Each round's
edges are written to the shared folder and read back; the tables of earlier
rounds are dropped.  Rounds go on until the edges no longer change, which takes
about log^2 of the number of nodes at most; there is no cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    way = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")),
                            F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return edges.select(way.alias("e")).select("e.u", "e.v")


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    sym = _both_ways(edges)
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sym.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: (u, v) longs.  Returns (id, root): every node that has an edge to
    another node, and the smallest node of its component."""
    edges = scratch.keep(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    while True:
        after = scratch.keep(small_star(large_star(edges)), "edges")
        now = _state(after)
        scratch.drop(edges)
        edges = after
        if now == before:
            break
        before = now
    # every edge now leads from a node to its root
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
