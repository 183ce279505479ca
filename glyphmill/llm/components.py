"""Connected components by alternating large and small stars, all in DataFrame operations.

Each step is one aggregation (combined map side, so a star with very many points moves one row
per task) and one join of two tables of the shared folder, so no lineage grows, no edge
reaches the driver, and the adaptive planner can split the rows of a very large star: it does
so only where both sides of a join are plain exchanges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spool


def _low(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges (a > b) relinked from b to the smallest neighbour of b, which is b itself where it has no smaller one."""
    j = edges.join(low.select(F.col("a").alias("b"), "m"), "b", "left")
    return j.select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node itself, relinked to the smallest of them."""
    moved = edges.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame, spool: Spool, name: str) -> DataFrame:
    """node, root (smallest node of its component) of all nodes of edges (a, b); roots themselves included."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before, i = spool.put(e, f"{name}-0"), None, 0
    while True:
        for step in (_large, _small):
            low = spool.put(_low(e), f"{name}-low-{i}")
            e = spool.put(step(e, low), f"{name}-{i + 1}")
            spool.drop(f"{name}-low-{i}")
            spool.drop(f"{name}-{i}")
            i += 1
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
