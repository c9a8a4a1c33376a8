"""Counts, rates and milestones of a running job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(done: Column, initial: Column, elapsed: Column) -> Column:
    return F.when(elapsed > 0, (done - initial) / elapsed).otherwise(0.0)


def eta(total: Column, done: Column, per_second: Column) -> Column:
    """Whole seconds that are left, null where nothing moves."""
    return F.when(per_second > 0, F.round((total - done) / per_second, 0).cast("long"))


def milestones(done: DataFrame, column: str, every: int, seen: DataFrame) -> DataFrame:
    """Multiples of `every` up to the count in the one row of `done` that `seen` hasn't had."""
    every = F.lit(every).cast("long")
    steps = done.where(F.col(column) >= every).select(F.explode(F.sequence(every, F.col(column).cast("long"), every)).alias("milestone"))
    return steps.join(seen.select(F.col("milestone").cast("long").alias("milestone")), "milestone", "left_anti")


def confirmed(samples: DataFrame, stream: str, order: str, reason: str, dedicated_mib: str, real_mib: int = 64) -> DataFrame:
    """Samples whose reason holds for the second time running, or at once with a real allocation."""
    before = F.lag(reason).over(Window.partitionBy(stream).orderBy(order))
    ok = F.col(reason).isNotNull() & ((F.col(dedicated_mib) >= real_mib) | before.isNotNull())
    return samples.withColumn("confirmed", F.coalesce(ok, F.lit(False)))


#: Desktop processes that never count as a foreign load (fixed values).
DESKTOP = ("dwm.exe", "lockapp.exe", "explorer.exe", "shellexperiencehost.exe")


def yield_reason(processes: DataFrame, own: DataFrame, used_mib: int, free_mib: int, baseline_mib: int | None = None, *, slack_mib: int = 256, need_mib: int | None = None) -> DataFrame:
    """One row with the first reason to give way, or null.

    processes: pid, name, dedicated_bytes, engine_percent; own: pid. A foreign process of 64 MiB or 1 %
    comes first, then use above the baseline, then too little free space. The slack and the need are
    parameters, as only sampled values are known.
    """
    foreign = processes.join(own.select("pid"), "pid", "left_anti").where(~F.lower("name").isin(*DESKTOP))
    foreign = foreign.where((F.col("dedicated_bytes") >= 64 * 1024 * 1024) | (F.col("engine_percent") >= 1))
    more = baseline_mib is not None and used_mib > baseline_mib + slack_mib
    scarce = need_mib is not None and free_mib < need_mib
    reason = F.when(F.count("*") > 0, "foreign_5090_process").when(F.lit(more), "additional_5090_memory_use").when(F.lit(scarce), "5090_not_available")
    return foreign.agg(reason.alias("reason"))
