"""Connected components of a graph given by its links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import measured, stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes: each step points nodes at the smallest of their
    neighbours, and the number of steps grows with the logarithm of a component's width. A hub's links are aggregated
    before the shuffle and joined to its smallest neighbour; no task gathers a component. Each step is written to the
    shared folder, so lost executors cost one step at most; whether it changed anything is told by sums taken on the way there.
    """
    sums = F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hashes")
    edges, state = measured(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components", *sums)
    while state["n"]:
        # Large star: every larger neighbour of a node is linked to the smallest in the node's neighbourhood.
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        star = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        joined = star.join(star.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = joined.select(F.inline(F.array(*[F.struct(F.col(c).alias("a"), F.col("m").alias("b")) for c in ("a", "b")]))).where("a != b").distinct()
        edges, now = measured(small, "components", *sums)
        if now == state:
            break
        state = now
    nodes = F.inline(F.array(*[F.struct(F.col(c).alias("node"), F.col("b").alias("root")) for c in ("a", "b")]))
    return stored(edges.select(nodes).distinct(), "component-roots")
