"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlake.llm.common import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v): neighbours of a node move to the smallest of them.

    Large: those above the node; small: those below it, and the node itself. A node with very many
    neighbours is one row of the minima, so the join splits its edges.
    """
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select("u", "v")
    least = near.groupBy(F.col("u").alias("_u")).agg(F.least(F.min("v"), F.first("u")).alias("root"))
    met = near.join(least, F.col("u") == F.col("_u"))
    if large:
        moved = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("root").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("root").alias("v")).unionByName(
            least.select(F.col("_u").alias("u"), F.col("root").alias("v"))
        )
    return moved.where(F.col("u") != F.col("v"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one root that hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.where("hangs > 1 OR hangs = 1 AND holds = 1").isEmpty()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every linked node that is no root: the smallest node it is connected with.

    links has a and b. Each round is written; edges shrink to stars in a number of rounds that grows with
    the logarithm of the longest chain. What it returns serves as links again.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges, round_ = scratch.keep(edges, f"{name}0"), 0
    while not _are_stars(edges):
        round_ += 1
        edges = scratch.keep(_stars(_stars(edges, True), False).distinct(), f"{name}{round_}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
