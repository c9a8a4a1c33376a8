"""How queries are registered, and the driver tables seen as a knowledge base."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (table, spark) under its name; table(name) reads a driver table."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Documents as records with versions and entities, some of them broken on purpose by their numbers.
KB = """
records as (select doc_id as id, doc_id % 97 as entity_id, source as source_id, case when doc_id % 50 = 0 then null else doc_id * 10 + 1 end as current_version,
    doc_id % 7 <> 0 as active, lang as universe, text as body from documents),
versions as (select doc_id * 10 + 1 as id, case when doc_id % 61 = 0 then doc_id + 1 else doc_id end as record_id,
    case doc_id % 3 when 0 then 'transcribed_reference' when 1 then 'phase3_extraction' else 'import' end as origin, lang as universe, n_chars from documents),
profiles as (select doc_id * 10 + 1 as version_id, doc_id % 13 as hull from documents where doc_id % 4 = 0),
entities as (select distinct doc_id % 97 as id, case when doc_id % 97 in (5, 11, 17) then null when doc_id % 97 % 3 = 0 then (doc_id % 97 * 2 + 3) % 96 else null end as redirect_to
    from documents where doc_id % 97 <> 23)
"""


def records(table) -> DataFrame:
    return table("documents").select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % 97).alias("entity_id"),
        F.col("source").alias("source_id"),
        F.when(F.col("doc_id") % 50 != 0, F.col("doc_id") * 10 + 1).alias("current_version"),
        (F.col("doc_id") % 7 != 0).alias("active"),
        F.col("lang").alias("universe"),
        F.col("text").alias("body"),
    )


def versions(table) -> DataFrame:
    d = F.col("doc_id")
    origin = F.when(d % 3 == 0, "transcribed_reference").when(d % 3 == 1, "phase3_extraction").otherwise("import")
    return table("documents").select((d * 10 + 1).alias("id"), F.when(d % 61 == 0, d + 1).otherwise(d).alias("record_id"), origin.alias("origin"), F.col("lang").alias("universe"), "n_chars")


def profiles(table) -> DataFrame:
    d = F.col("doc_id")
    return table("documents").where(d % 4 == 0).select((d * 10 + 1).alias("version_id"), (d % 13).alias("hull"))


def entities(table) -> DataFrame:
    e = F.col("doc_id") % 97
    to = F.when(e.isin(5, 11, 17), None).when(e % 3 == 0, (e * 2 + 3) % 96)
    return table("documents").where(e != 23).select(e.alias("id"), to.alias("redirect_to")).distinct()


#: Nations as systems, with routes to the 1st, 4th and 9th next ones; hours are unknown for some.
ROUTES = """
routes as (select n_nationkey * 10 + s as id, n_nationkey as a, (n_nationkey + s) % 25 as b, case when (n_nationkey + s) % 5 = 0 then 'rift' when s = 4 then 'secondary' else 'trade' end as kind,
    case when n_nationkey % 6 = 5 then null else 1.0 + (n_nationkey * 7 + s * 13) % 23 + n_nationkey / 64.0 + s / 1024.0 end as hours_min,
    case when n_nationkey % 6 = 5 then null else 3.0 + (n_nationkey * 7 + s * 13) % 23 + (n_nationkey % 4) end as hours_max
    from nation, (values (1), (4), (9)) as v(s))
"""


def routes(table) -> DataFrame:
    n, s = F.col("n_nationkey"), F.col("s")
    known = n % 6 != 5
    rows = table("nation").select("n_nationkey", F.explode(F.array(F.lit(1), F.lit(4), F.lit(9))).alias("s"))
    kind = F.when((n + s) % 5 == 0, "rift").when(s == 4, "secondary").otherwise("trade")
    base = ((n * 7 + s * 13) % 23).cast("double")
    return rows.select((n * 10 + s).alias("id"), n.alias("a"), ((n + s) % 25).alias("b"), kind.alias("kind"), F.when(known, 1.0 + base + n / 64.0 + s / 1024.0).alias("hours_min"), F.when(known, 3.0 + base + n % 4).alias("hours_max"))
