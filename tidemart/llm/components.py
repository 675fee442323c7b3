"""Connected components of a graph given as an edge table, by alternating stars.

Large-star links every larger neighbour of a vertex to the smallest vertex next
to it; small-star does so for the smaller ones.  Both keep components as they
are, and repeated they leave one star around the smallest vertex of each.  Edges
stay in tables throughout; only one number a round reaches the driver.  Minima
are pre-aggregated before each shuffle and the edges of a vertex with very many of
them stay where they are, so it costs no single task.

Edge cases: null ends and loops are ignored; repeated edges count once; vertices
without an edge aren't returned; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:  # a vertex and all its neighbours
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:  # a vertex and its smaller neighbours
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = looked_up(near, least, ["u"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("b"), F.col("m").alias("a")).union(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return out.where("a <> b").select("a", "b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``vertex``, ``component`` (its smallest vertex) for every vertex on an edge of ``a``, ``b``."""
    now = materialize(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:  # each round shrinks some component's distance to its smallest vertex
        after = materialize(_star(materialize(_star(now, large=True), "edges"), large=False), "edges")
        # one star a component: no vertex is both a centre and a leaf, or a leaf twice
        centres = after.select(F.col("a").alias("x")).distinct()
        again = after.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select(F.col("b").alias("x"))
        if after.select(F.col("b").alias("x")).join(centres, "x", "left_semi").unionByName(again).isEmpty():
            leaves = after.select(F.col("b").alias("vertex"), F.col("a").alias("component"))
            return leaves.unionByName(after.select(F.col("a").alias("vertex"), F.col("a").alias("component")).distinct())
        now = after
