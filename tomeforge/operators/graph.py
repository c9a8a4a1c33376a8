"""Chains, trees and routes."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; where none is named, one temporary folder of the session, in local mode only."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tomeforge-")
        context.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage, in the shared folder where the cluster names one."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def redirects_into_cycles(entities: DataFrame) -> DataFrame:
    """entities: (id, redirect_to). Ids whose chain of redirects reaches a cycle, once each.

    Pointers are doubled: after enough rounds to pass every entity, only chains that never end still
    point somewhere. A chain ends at a null or at an id that isn't there. log2(n) joins, no driver loop
    over rows.
    """
    hops = cut(entities.where("redirect_to is not null").select("id", F.col("redirect_to").alias("to")).join(entities.select(F.col("id").alias("to")), "to", "left_semi").select("id", "to").distinct())
    rounds = math.ceil(math.log2(max(2, hops.count()))) + 1
    for _ in range(rounds):
        onward = hops.select(F.col("id").alias("to"), F.col("to").alias("next"))
        hops = cut(hops.join(onward, "to").select("id", F.col("next").alias("to")))
        if hops.isEmpty():
            break
    return hops.select("id").distinct()


def descendants(nodes: DataFrame, root) -> DataFrame:
    """nodes: (id, parent). The root and everything below it, level by level; cycles end by themselves."""
    found = level = nodes.where(F.col("id") == root).select("id").distinct()
    while True:
        level = cut(nodes.join(level.select(F.col("id").alias("parent")), "parent").select("id").distinct().join(found, "id", "left_anti"))
        if level.isEmpty():
            return found
        found = cut(found.union(level))


def itinerary(routes: DataFrame, start, goal, *, factor: float = 1.0, secondary: bool = True, rift: bool = True) -> DataFrame:
    """routes: (id, a, b, kind, hours_min, hours_max), both directions, null hours unknown.

    The path of least total hours_min, of equal ones the one with the smaller route ids in order; its
    hours_max is the sum over that same path. Columns: nodes, routes, hours_min, hours_max,
    contains_rift; no row if the goal can't be reached. From a node to itself costs nothing.
    Relaxation in rounds: each round offers the improved nodes' paths to their neighbours and keeps the
    best offer of each node, until none improves.
    """
    if not (math.isfinite(factor) and factor > 0):
        raise ValueError("the factor must be finite and above 0")
    known = routes.where(F.col("hours_min").isNotNull() & F.col("hours_max").isNotNull())
    if not secondary:
        known = known.where("kind != 'secondary'")
    if not rift:
        known = known.where("kind != 'rift'")
    one = lambda x, y: known.select(F.col(x).alias("at"), F.col(y).alias("to"), "id", "kind", "hours_min", "hours_max")
    edges = cut(one("a", "b").union(one("b", "a")))
    ends = routes.select(F.col("a").alias("node")).union(routes.select("b")).where(F.col("node") == start).distinct()
    id_type = routes.schema["id"].dataType.simpleString()
    best = cut(ends.select("node", F.lit(0.0).alias("low"), F.array().cast(f"array<{id_type}>").alias("path"), F.lit(0.0).alias("high"), F.array("node").alias("nodes"), F.lit(False).alias("rift")))
    moved = best
    while True:
        offers = moved.join(edges, F.col("node") == F.col("at")).where(~F.array_contains("nodes", F.col("to")))
        offers = offers.select(
            F.col("to").alias("node"),
            (F.col("low") + F.col("hours_min")).alias("low"),
            F.concat("path", F.array("id")).alias("path"),
            (F.col("high") + F.col("hours_max")).alias("high"),
            F.concat("nodes", F.array("to")).alias("nodes"),
            (F.col("rift") | (F.col("kind") == "rift")).alias("rift"),
        )
        rank = Window.partitionBy("node").orderBy("low", "path")
        merged = best.withColumn("new", F.lit(False)).union(offers.withColumn("new", F.lit(True)))
        merged = cut(merged.withColumn("rank", F.row_number().over(rank)).where("rank = 1").drop("rank"))
        moved = merged.where("new").drop("new")
        best = merged.drop("new")
        if moved.isEmpty():
            break
    return best.where(F.col("node") == goal).select("nodes", F.col("path").alias("routes"), (F.col("low") * factor).alias("hours_min"), (F.col("high") * factor).alias("hours_max"), F.col("rift").alias("contains_rift"))
