"""Write-once snapshots of the best proposals with everything they refer to, checked after the copy.

A snapshot is a folder with one version of four tables (see sources/versions.py): `jobs`, `records`, `sources` and
`profiles`. The manifest says how many rows each has and a digest of them. A folder that holds anything already is
refused; one without a manifest was not finished. Opening a snapshot checks it: identities of records and jobs are those
that follow from their contents, versions those of the records, each job's records are there, and the digests are the manifest's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.operators.records import in_scope, snapshot
from tomeforge.sources.exports import digests
from tomeforge.sources.versions import Versions

TABLES = ("jobs", "records", "sources", "profiles")


class Refused(RuntimeError):
    """A snapshot that isn't what it was when it was made."""


def _id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16))


def record_id(source_key: Column) -> Column:
    return _id("rec-", source_key)


def job_id(task: Column, a: Column, b: Column) -> Column:
    return _id("job-", task, a, b)


def version_of(name: Column, universe: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in (name, universe, body))), 256)


class Pilot:
    def __init__(self, spark: SparkSession, folder: str):
        self.store = Versions(spark, folder)

    def create(self, proposals: DataFrame, records: DataFrame, sources: DataFrame, profiles: DataFrame, limit: int, scope: DataFrame | None = None) -> dict[str, int]:
        """The best `limit` (1 to 10,000) pending proposals, with records, sources and profiles; the number of rows of each table.

        proposals: (id, task, a, b, score, status); records: (id, source_key, source_id, name, universe, body, current_version);
        sources: (source_id, title); profiles: (version_id, stats); scope: (id) of records whose proposals count.
        """
        if self.store._listed(self.store.folder):
            raise FileExistsError(f"snapshots are written once: {self.store.folder}")
        pending = proposals.where("status = 'pending'")
        best = in_scope(pending, "a", scope).orderBy(F.desc("score"), "a", "id").limit(limit)
        held = snapshot(pending, records.select("id", "source_id", "current_version"), sources.select("source_id", "title"), profiles.select("version_id"), limit, scope)
        ids = held.select("id").distinct()
        copied = records.join(ids, "id", "left_semi")
        tables = {
            "jobs": best.select("id", "task", "a", "b", "score"),
            "records": copied.select("id", "source_key", "source_id", "name", "universe", "body", "current_version"),
            "sources": sources.join(copied.select("source_id").distinct(), "source_id", "left_semi").select("source_id", "title"),
            "profiles": profiles.join(copied.select(F.col("current_version").alias("version_id")).distinct(), "version_id", "left_semi").select("version_id", "stats"),
        }
        one = F.lit(0).alias("part")
        made = {name: (rows.select("*", one), None, [rows.columns[0]]) for name, rows in tables.items()}
        # the digests are those of the rows as they were read from where they were written
        self.store.commit(made, 0, lambda done: {"snapshot": {name: self._digest(rows) for name, rows in done.items()}})
        self.open()
        return {name: n for name, (n, _) in self.store.manifest()["snapshot"].items()}

    @staticmethod
    def _digest(rows: DataFrame) -> list:
        line = F.to_json(F.struct(*(c for c in rows.columns if c != "part")), {"ignoreNullFields": "false"})
        found = digests(rows.select(F.lit(0).alias("part"), line.alias("value"))).first()
        return [found["n_lines"], found["digest"]] if found else [0, ""]

    def read(self, table: str) -> DataFrame:
        return self.store.read(table).drop("part")

    def errors(self) -> DataFrame:
        """(table, id, error): identity, version, job, record (of a job, that isn't there) and repeated."""
        jobs, records = self.read("jobs"), self.read("records")
        say = lambda rows, table, error: rows.select(F.lit(table).alias("table"), F.col("id"), F.lit(error).alias("error"))
        ends = jobs.select("a").union(jobs.select("b")).where("a is not null").distinct().withColumnRenamed("a", "id")
        checks = [
            say(records.where(~F.col("id").eqNullSafe(record_id(F.col("source_key")))), "records", "identity"),
            say(records.where(~F.col("current_version").eqNullSafe(version_of(F.col("name"), F.col("universe"), F.col("body")))), "records", "version"),
            say(jobs.where(~F.col("id").eqNullSafe(job_id(F.col("task"), F.col("a"), F.col("b")))), "jobs", "job"),
            say(ends.join(records.select("id"), "id", "left_anti"), "jobs", "record"),
            *(say(rows.groupBy("id").count().where("count > 1"), name, "repeated") for name, rows in (("jobs", jobs), ("records", records))),
        ]
        return reduce(DataFrame.union, checks)

    def open(self) -> dict[str, DataFrame]:
        """The tables by name; Refused if the snapshot wasn't finished, was changed, or doesn't hold together."""
        if not self.store.number():
            raise Refused("not finished: there is no manifest")
        said = self.store.manifest()["snapshot"]
        for name in TABLES:
            try:
                found = self._digest(self.read(name))
            except Exception as e:
                raise Refused(f"{name} can't be read") from e
            if found != said[name]:
                raise Refused(f"{name} has changed: {found[0]} rows, {said[name][0]} were written")
        broken = self.errors().groupBy("table", "error").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()  # a row for each kind
        if broken:
            raise Refused("; ".join(f"{r['table']}: {r['n']} {r['error']}, first {r['first']}" for r in broken))
        return {name: self.read(name) for name in TABLES}
