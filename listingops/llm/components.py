"""Connected components of a link table, in rounds of large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingops.llm.common import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Edges (u, v), u > v, after one step: each node's neighbours (small: those no larger) move to the least of them."""
    out = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = out.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    near = out.join(least, "u")
    moved = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    else:
        moved = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node stands under one root: no node twice on the left, none on both sides."""
    if not edges.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, root: the least node of its component, for every node of links(a, b) but the roots themselves.

    Null ends and loops are no links. Each round's edges are a written table; rounds end when every node stands under
    its root. Rounds grow with the logarithm of the longest chain; after most_rounds a RuntimeError is raised.
    """
    edges = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "edges")
    for _ in range(most_rounds):
        if _settled(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = written(_star(_star(edges, False), True), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
