"""Connected components of a graph in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gavel.llm.common import stored


def _all_stars(links: DataFrame) -> bool:
    """Whether every node of ``links`` has one neighbour below it that has none itself."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(
        links.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    met = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return met.filter("below > 1 OR (below = 1 AND above = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the edges (x, y): root is the smallest node reachable.

    Alternates large-star and small-star steps, which keep the components and pull every node
    towards its smallest neighbour, until only stars are left; that takes about log(diameter) rounds.
    A step is one minimum per node and a join, so a node may have any number of neighbours.
    Loops and repeated edges are harmless.
    """
    links = stored(
        edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        .filter("u > v")
        .distinct(),
        "links",
    )
    while not _all_stars(links):
        # Large star: larger neighbours of a node go to its smallest neighbour, or to itself. As many rows
        # as links at most, repeated ones included, which the small star makes one.
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(
            both.filter("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u > v"),
            "large-star",
        )
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        links = stored(
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v")))
            .filter("u > v")
            .distinct(),
            "small-star",
        )
    # Every node now points at its root.
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) as of :func:`components`, after further edges (x, y) between its nodes or new ones.

    Only the components that the edges touch are joined, each as one node.
    """
    named = edges.select("x", "y")
    for end in ("x", "y"):
        known = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        named = named.join(known, end, "left").withColumn(f"_{end}", F.coalesce("_root", end)).drop("_root")
    named = stored(named, "joined-edges")
    merged = stored(components(named.select(F.col("_x").alias("x"), F.col("_y").alias("y"))), "joined-roots")
    moved = merged.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    old = roots.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return old.unionAll(merged.join(roots.select("node"), "node", "left_anti").select("node", "root"))
