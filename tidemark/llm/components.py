"""Connected components of an edge table by alternating large and small stars.

Every step is a grouped minimum and a join, so no component gathers in one task. The
number of rounds grows with the logarithm of the largest distance in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point a node's larger (large) or smaller-or-equal neighbours to its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Are the edges stars, each node pointing to one root that points nowhere?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    per_node = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per_node.where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "components") -> DataFrame:
    """(node, component) of every node of edges (u, v): the least node that it reaches.

    Nulls, self-loops and repeated edges are ignored; isolated nodes are not listed.
    """
    u, v = F.col("u").cast("long"), F.col("v").cast("long")
    now = scratch.table(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), f"{label}-0")
    step = 0
    while not _settled(now):
        step += 1
        new = scratch.table(_star(_star(now, True), False), f"{label}-{step}")
        scratch.drop(f"{label}-{step - 1}")
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
