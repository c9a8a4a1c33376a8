"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.llm.tables import removed, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One step over pairs (a, b), b < a: neighbours move to the least one that their centre knows."""
    both = pairs.select("a", "b")
    if large:
        both = both.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.join(least, "a")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) in any order. Returns (node, component), the component being its least node.

    Nodes without a link are not listed; null ends and links to itself are ignored. A hub is a key
    with many rows on one side of a join whose other side has one row, so that Spark can split it.
    Each step is written to the shared folder, so that a lost executor costs a step at most; the one
    before it is deleted then.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = written(ordered, "links")
    before = _state(edges)
    while before[0]:
        last, edges = edges, written(_star(_star(edges, True), False), "links")
        removed(edges.sparkSession, last.folder)
        now = _state(edges)
        if now == before:
            break
        before = now
    # a star for each component is left
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()
