"""Connected components of links by alternating stars, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractloom.llm.runtime import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a > b). Large: larger neighbours of a node go to its least neighbour. Small: the smaller ones do."""
    if large:
        ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = ends.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = ends.groupBy("u").agg(F.min("v").alias("m"))
        moved = ends.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node in links (a, b); root: the least node that it reaches.

    Each round is written to the shared folder, so that lineage stays short. Rounds end when the edges stop
    changing, which takes a number of rounds that grows with the logarithm of the longest path.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = mark(edges)
    for _ in range(most):
        if not before[0]:
            break
        edges = stored(_stars(_stars(edges, True), False), "stars")
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
