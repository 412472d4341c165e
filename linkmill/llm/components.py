"""Connected components of a large undirected graph, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _nearest(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, or the node itself if that is smaller."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether each node is a centre or has one edge to a centre: then nothing changes any more."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("degree"))
    return not ends.filter("down > 0 AND degree > 1").agg(F.count("*")).first()[0]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (``u, v``).

    Alternates two steps until only stars are left, which neither changes: every node hands its larger neighbours to its smallest neighbour, then
    its smaller ones. Each keeps the components and shortens the paths, so the rounds grow with the logarithm of the
    longest path. Minima are combined before the shuffle, and the join with them is an ordinary one (a node with very
    many neighbours is a skewed key that adaptive execution splits). Each round is written to the checkpoint folder.
    An empty table gives an empty result.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = cut_lineage(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.filter("v > u").join(_nearest(edges), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # now u > v in every row: each node's smaller neighbours
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        edges = cut_lineage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if _stars(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    star = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def apart(rows: DataFrame, parts: DataFrame, member: str, keys: list[str]) -> DataFrame:
    """``rows`` of the keys whose members lie in more than one component, with ``component``, the key's ``largest`` one and its ``members``.

    A member that ``parts`` (``node, component``) doesn't name is a component of its own. Counts are combined by key and
    component before the shuffle by key.
    """
    placed = rows.join(parts.withColumnRenamed("node", member), member, "left").withColumn("component", F.coalesce("component", member))
    placed = cut_lineage(placed)
    sizes = placed.groupBy(*keys, "component").count()
    sizes = sizes.groupBy(*keys).agg(F.max_by("component", F.struct("count", "component")).alias("largest"), F.count("*").alias("several"), F.sum("count").alias("members"))
    return placed.join(sizes.filter("several > 1").drop("several"), keys)
