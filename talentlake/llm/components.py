"""Connected components of an edge table by alternating star contraction.

Each round links every node's larger neighbours to its least one (large star)
and then its smaller neighbours to the least of them (small star), which at
least halves the depth; every round is written to the shared folder, so a lost
executor repeats one round at most. Rounds work on rows of edges only: no
component or adjacency list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key, materialize


def _star(edges: DataFrame, both_sides: bool) -> DataFrame:
    """(a, b) with a > b: each node's neighbours linked to the least neighbour."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both_sides:
        near = near.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = materialize(near, "neighbours")
    least = materialize(near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
                        .withColumn("m", F.least("u", "m")), "least")
    linked = attach_by_key(near, least, "u", "n", near.count())
    if both_sides:
        linked = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b), root being the component's least node."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = materialize(edges, "edges")
    state = None
    while True:
        large = materialize(_star(edges, True), "large-star")
        edges = materialize(_star(large, False), "small-star")
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
