"""Connected components of a distributed edge table (alternating large and small stars)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over ``(a, b)``: each node hands its smallest neighbour to the
    larger neighbours (large star) or to the smaller ones and itself (small star)."""
    if large:
        near = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    linked = near.join(low, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node of
    its component.  Hub nodes are never gathered: minima are partial aggregates and joins.
    Each round is checkpointed; rounds grow with the logarithm of the largest component."""
    edges = cut(edges.select("a", "b").where("a <> b").distinct())

    def state(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(edges)
    while True:
        edges = cut(_star(_star(edges, True), False))
        was, now = now, state(edges)
        if now == was:
            break
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct())
