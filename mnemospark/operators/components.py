"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _minima(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of every node, itself included. ``edges``: (a, b)."""
    return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour. Edges come with a > b."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(_minima(both), "a").where(F.col("b") > F.col("a"))
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to the smallest of them. Edges come with a > b."""
    least = _minima(edges)
    down = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``edges``; the component is its smallest node.

    Each round replaces the edges by those of one large-star and one small-star step, written once to the shared
    folder; it ends when a round leaves them as they were. Rounds grow with the logarithm of the longest path, and
    no node's neighbours are ever gathered in a task: a step joins the edges with one minimum per node, so a hot
    node is split by the adaptive skew join. NULL ends, loops and repeated edges are ignored; no edges, no rows.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(e)
    while before[0]:
        e = cut(_small_star(_large_star(e)))
        now = mark(e)
        if now == before:
            break
        before = now
    members = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
