"""Connected components of a graph given as edges, by alternating large and small stars.

Each step is a sum by node and a join with it, so a node with very many neighbours costs a row for each task before
rows move, and the join has one row on its side. Edges are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's neighbours are linked to the least of it and them."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # The link of a node to its own least neighbour comes from the neighbours' rows for large stars.
    linked = both.join(least, "u")
    if large:
        linked = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return linked.filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and label (the least node of its component) for every node of the edges (columns u and v, comparable)."""
    own = scratch.save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges-0")
    mark, k = None, 0
    while True:
        k += 1
        after = scratch.save(_stars(_stars(own, True), False), f"{name}-edges-{k}")
        scratch.drop(f"{name}-edges-{k - 1}")
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        own = after
        if now == mark:
            break
        mark = now
    # Stars whose centre is their least node.
    leaves = own.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.union(own.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
