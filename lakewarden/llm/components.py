"""Connected components of a graph given by its edges, in rounds of star operations.

A round replaces each node's larger neighbours' edges, then its smaller ones, by
edges to the least node it sees. Edges never grow in number, and the graph
becomes one star per component in about log(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, least): each edge with the least of u and u's neighbours, aggregated before it meets."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("least"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): of every node with an edge (columns u, v) the least node it is linked with.

    Loops and repeated edges do no harm; of no edges the result is empty.
    """
    now = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "graph"
    )
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        large = written(large.where("u != v"), "graph")
        discard(now)
        small = _star(large)  # here v < u always
        # the edges of u to smaller nodes, now to the least of them, and u itself
        moved = small.where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        own = small.select("u", F.col("least").alias("v"))
        now = written(moved.union(own).where("u != v").distinct(), "graph")
        discard(large)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
