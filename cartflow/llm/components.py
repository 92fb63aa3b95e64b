"""Connected components over DataFrames: by alternating star contractions, of forests by doubling steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartflow.llm.common import materialize


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest one among them and it.

    The minimum is a grouping with map-side combine; the join back may be split by adaptive execution.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sides = both if large else both.where("v < u")
    least = sides.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("low"))
    chosen = both.where("v > u") if large else sides
    linked = chosen.join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    if not large:
        linked = linked.unionByName(least.select(F.col("node").alias("u"), F.col("low").alias("v")))
    return linked.where("u <> v").distinct()


def is_star(edges: DataFrame) -> bool:
    """True if every node is either the end of one edge or only the root of edges, so that `v` is the component of `u`."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("n")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("n")))
    met = ends.groupBy("node").agg(F.sum("n").alias("out"), F.min("n").alias("least"))
    return met.where("out > 1 or (out = 1 and least = 0)").isEmpty()


def with_roots(stars: DataFrame) -> DataFrame:
    """node, root: the ends of the edges (u, v) and the roots themselves."""
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of `edges` (u, v) with the smallest node of its component.

    Each round is stored in the shared folder, so that the lineage stays short and a lost executor costs one round.
    The number of rounds grows with the logarithm of the size of a component.
    """
    now = edges.where("u <> v").select("u", "v").distinct()
    while True:
        now = materialize(star(star(now, True), False), "components")
        if is_star(now):
            return with_roots(now)


def forest(parents: DataFrame) -> DataFrame:
    """node, root: every node of `parents` (u, v), which has at most one row for each u and no cycle, with the end of its path.

    Each stored round doubles the length of the steps; a forest of stars takes one.
    """
    now = parents.select("u", "v")
    while True:
        after = now.select(F.col("u").alias("node"), F.col("v").alias("next"))
        further = F.coalesce("next", "v").alias("v")
        now = now.join(after, now["v"] == after["node"], "left").select("u", further, F.col("next").isNotNull().alias("moved"))
        now = materialize(now, "forest")
        if now.where("moved").isEmpty():
            return with_roots(now)
        now = now.select("u", "v")
