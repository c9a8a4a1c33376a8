"""Constraint checks as queries: what breaks a rule comes back as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, with their counts."""
    return df.groupBy(*keys).count().where("count > 1").withColumnRenamed("count", "rows")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-null reference isn't a parent's key."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def wrong_owner(records: DataFrame, versions: DataFrame) -> DataFrame:
    """records: (id, current_version); versions: (id, record_id). Records whose version is missing or another's."""
    v = versions.select(F.col("id").alias("current_version"), "record_id")
    return records.join(v, "current_version", "left").where(F.col("record_id").isNull() | (F.col("record_id") != F.col("id"))).select("id", "current_version", "record_id")


def index_errors(records: DataFrame, indexed: DataFrame, key: str = "id", ref: str = "record_id") -> DataFrame:
    """Records without exactly one index entry, with the number that they have."""
    entries = indexed.groupBy(F.col(ref).alias(key)).agg(F.count("*").alias("entries"))
    rows = records.select(key).join(entries, key, "left").select(key, F.coalesce("entries", F.lit(0)).alias("entries"))
    return rows.where("entries != 1")


def hash_mismatches(rows: DataFrame, digest: str, *fields: str) -> DataFrame:
    """Rows whose stored digest isn't that of the fields as JSON."""
    return rows.where(~F.col(digest).eqNullSafe(fingerprint(*fields)))


def fingerprint(*fields: str) -> Column:
    """sha256 of the fields as one JSON object, in the given order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def rule_breaks(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each row and rule that doesn't hold; a null result counts as broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """(error, errors) for each check, 0 where all is well."""
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("errors")).select(F.lit(name).alias("error"), "errors") for name, df in checks.items()])
