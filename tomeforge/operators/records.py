"""Writes against expected revisions, quotes, snapshots, stages and recoveries, as checks over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def optimistic_writes(current: DataFrame, writes: DataFrame, valid: Column) -> DataFrame:
    """current: (id, body); writes: (id, seq, expected, body). (id, seq, status, revision): each write's status and the new revision.

    A revision is the SHA-256 of a body. Of the valid writes that expect a row's revision the first by seq
    is saved; the others find another revision then and are conflicts, as those that expected another one.
    Writes to ids that aren't there are unknown. Bodies are hashed where they are read and stay behind;
    saved_rows() fetches those that are saved.
    """
    held = current.select("id", F.sha2("body", 256).alias("revision"))
    rows = writes.select("id", "seq", "expected", F.coalesce(valid, F.lit(False)).alias("valid"), F.sha2("body", 256).alias("new")).join(held, "id", "left")
    fits = F.col("expected").eqNullSafe(F.col("revision"))
    first = F.row_number().over(Window.partitionBy("id", "expected", "valid").orderBy("seq")) == 1
    status = F.when(F.col("revision").isNull(), "unknown").when(~fits, "conflict").when(~F.col("valid"), "invalid").when(first, "saved").otherwise("conflict")
    rows = rows.withColumn("status", status)
    return rows.select("id", "seq", "status", F.when(F.col("status") == "saved", F.col("new")).otherwise(F.col("revision")).alias("revision"))


def saved_rows(current: DataFrame, writes: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table after optimistic_writes(), the bodies that were replaced, to be kept as a backup, and ids that aren't unique.

    An id that `current` has more than once, or a saved (id, seq) that `writes` has more than once, is named in the third
    table, and its rows stay as they are.
    """
    saved = done.where("status = 'saved'").select("id", "seq")
    repeated = lambda rows: rows.groupBy(*rows.columns).count().where("count > 1").select("id")
    unclear = repeated(current.select("id")).union(repeated(writes.select("id", "seq").join(saved, ["id", "seq"], "left_semi"))).distinct()
    new = writes.join(saved.join(unclear, "id", "left_anti"), ["id", "seq"], "left_semi").select("id", F.col("body").alias("new"))
    both = current.join(new, "id", "left")
    return both.select("id", F.coalesce("new", "body").alias("body")), both.where("new is not null").select("id", "body"), unclear


def quote_errors(quotes: DataFrame) -> DataFrame:
    """quotes: id, text, start (from 0), quote, sha256. Those that aren't the text's characters there, with the first reason."""
    size = F.length("quote")
    reason = (
        F.when(F.col("text").isNull() | F.col("quote").isNull() | (size == 0), "empty")
        .when((F.col("start") < 0) | (F.col("start") + size > F.length("text")), "bounds")
        .when(F.substring("text", F.col("start").cast("int") + 1, size) != F.col("quote"), "text")
        .when(~F.col("sha256").eqNullSafe(F.sha2("quote", 256)), "hash")
    )
    return quotes.select("id", reason.alias("reason")).where("reason is not null")


def in_scope(rows: DataFrame, key: str, scope: DataFrame | None) -> DataFrame:
    """The rows whose key is in the scope's ids; all without a scope."""
    return rows if scope is None else rows.join(scope.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def snapshot(proposals: DataFrame, records: DataFrame, sources: DataFrame, profiles: DataFrame, limit: int, scope: DataFrame | None = None) -> DataFrame:
    """The records at both ends of the best `limit` (1 to 10,000) proposals, each with its source and profile.

    proposals: (a, b, id, score); records: (id, source_id, current_version); sources: (source_id, title);
    profiles: (version_id, ...). `found` is false where a proposal names a record that isn't there.
    """
    if not 1 <= limit <= 10_000:
        raise ValueError("a snapshot takes 1 to 10,000 proposals")
    best = in_scope(proposals, "a", scope).orderBy(F.desc("score"), "a", "id").limit(limit)
    ids = best.select(F.col("a").alias("id")).union(best.select("b")).na.drop().distinct()
    held = ids.join(records.withColumn("found", F.lit(True)), "id", "left").join(sources, "source_id", "left")
    held = held.join(profiles.withColumnRenamed("version_id", "current_version"), "current_version", "left")
    return held.withColumn("found", F.coalesce("found", F.lit(False)))


def stages_run(stages: DataFrame, plan: str, priority: list[str], ok: Column) -> DataFrame:
    """Of each plan's stages, by priority, those up to the first that isn't ok, that one included."""
    order = Window.partitionBy(plan).orderBy(*priority).rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.sum(F.when(ok, 0).otherwise(1)).over(order), F.lit(0))
    return stages.withColumn("failed_before", failed).where("failed_before = 0").drop("failed_before")


def recovery_plan(pages: DataFrame) -> DataFrame:
    """pages: id, complete, engine, wanted_engine, source_sha256, now_sha256, chars, text, marked. What may be recovered from native text.

    `action` is recover, or the first precondition that fails: the scan must be complete, by the same
    engine, of a source that hasn't changed, with as many characters as reported, and not marked yet.
    """
    action = (
        F.when(~F.coalesce("complete", F.lit(False)), "incomplete")
        .when(~F.col("engine").eqNullSafe(F.col("wanted_engine")), "engine")
        .when(~F.col("source_sha256").eqNullSafe(F.col("now_sha256")), "source_changed")
        .when(F.col("chars") != F.length(F.coalesce("text", F.lit(""))), "characters")
        .when(F.col("marked"), "marked")
        .otherwise("recover")
    )
    return pages.select("id", action.alias("action"))
