"""Connected components by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: for every node with an edge, the smallest node it reaches.

    A node's neighbours are never gathered: each step takes a minimum, which is
    summed up before the shuffle, and joins it back, a join that adaptive
    execution splits where a node has very many edges.  Each round is written to
    the shared folder.  Edges with a null end and loops are ignored; no edges
    give no rows.
    """
    a, b = F.col(a), F.col(b)
    edges = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = written(edges, "components")
    while True:
        large = _star(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger=True)
        small = written(_star(large, larger=False), "components")
        # at a fixed point every edge points at a root, no root points on, and no node has two roots
        done = small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and small.groupBy("u").count().filter("count > 1").isEmpty()
        drop_written(edges)
        edges = small
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Large star: neighbours above u go to the least of u's neighbourhood; small star: those below, and u itself."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = edges.join(least, "u")
    if larger:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()
