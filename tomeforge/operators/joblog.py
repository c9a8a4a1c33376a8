"""Jobs by exact request, with a log that only grows.

prepare() upserts jobs (job, position, request, source_sha256). A run takes the pending jobs in order of position,
and settles each: `cached` if its request has an answer already, from any earlier job, or `done` with the
answer that `evaluate` gives; a job whose source isn't the one it was prepared with is `refused`, and stays
pending. A job is settled for the request it was settled with: one that is prepared anew with another request
is pending again. Nothing is taken while the log is paused.

Each run is one part of the log, which becomes visible as a whole (see sources/versions.py). A run
that finds the log changed by another one since it began is refused with Conflict and leaves no trace; when it
is run again it takes what is still pending. So the log is as if runs had come one after the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.operators.index import bucket
from tomeforge.sources.versions import Versions

LOG = "run int, job long, position long, request string, event string, answer string"
SETTLED = ("done", "cached")


class JobLog:
    def __init__(self, spark: SparkSession, folder: str, parts: int = 16):
        self.spark, self.store, self.parts = spark, Versions(spark, folder), parts

    def jobs(self) -> DataFrame:
        return self.store.read("jobs").drop("part")

    def log(self) -> DataFrame:
        """LOG of all runs so far."""
        names = [c.split()[0] for c in LOG.split(", ")]
        return self.store.read("log").select(*names) if "log" in self.store.manifest()["tables"] else self.spark.createDataFrame([], LOG)

    def _more(self, **changes) -> dict:
        held = self.store.manifest()
        return {"paused": held.get("paused", False), "runs": held.get("runs", 0)} | changes

    def prepare(self, jobs: DataFrame) -> int:
        """Adds new jobs and replaces those whose position, request or source differs; the number of both. The same jobs again change nothing."""
        manifest = self.store.manifest()
        rows = jobs.select(F.col("job").cast("long").alias("job"), F.col("position").cast("long").alias("position"), "request", "source_sha256")
        rows = rows.withColumn("part", bucket(F.col("job").cast("string"), self.parts))
        if "jobs" not in manifest["tables"]:
            self.store.commit({"jobs": (rows, None, ["job"])}, manifest["version"], self._more())
            return self.jobs().count()
        old = self.store.read("jobs")
        same = [rows[c].eqNullSafe(old[c]) for c in ("job", "position", "request", "source_sha256")]
        fresh = rows.join(old, same[0] & same[1] & same[2] & same[3], "left_anti")
        touched = {r["part"]: r["count"] for r in fresh.groupBy("part").count().collect()}  # `parts` at most
        if touched:
            parts = sorted(touched)
            kept = self.store.read("jobs", parts).join(fresh.select("job"), "job", "left_anti").select(*rows.columns)
            self.store.commit({"jobs": (kept.union(fresh), parts, ["job"])}, manifest["version"], self._more())
        return sum(touched.values())

    def pause(self, paused: bool = True) -> None:
        if self.store.manifest().get("paused", False) != paused:
            self.store.commit({}, self.store.number(), self._more(paused=paused))

    def pending(self) -> DataFrame:
        """Jobs that aren't settled for their request."""
        return self.jobs().join(self.log().where(F.col("event").isin(*SETTLED)).select("job", "request"), ["job", "request"], "left_anti")

    def begin(self, sources: DataFrame, limit: int | None = None) -> Run:
        """A run over the first `limit` pending jobs in order (all: None). sources: (job, sha256) as they are now."""
        return Run(self, sources, limit)


class Run:
    def __init__(self, owner: JobLog, sources: DataFrame, limit: int | None):
        self.owner, self.manifest = owner, owner.store.manifest()
        self.number = self.manifest.get("runs", 0) + 1
        now = sources.select("job", F.col("sha256").alias("now"))
        rows = owner.pending().join(now, "job", "left").withColumn("changed", ~F.col("now").eqNullSafe(F.col("source_sha256")))
        if self.manifest.get("paused", False):
            rows = rows.limit(0)
        taken = rows.where("not changed").orderBy("position", "job").limit(limit) if limit is not None else rows.where("not changed")
        refused = rows.where("changed")
        if limit is not None and taken.count() == limit:
            last = taken.agg(F.max(F.struct("position", "job")).alias("last")).first()["last"]
            refused = refused.where(F.struct("position", "job") < F.struct(F.lit(last["position"] if last else None).alias("position"), F.lit(last["job"] if last else None).alias("job")))
        self.taken, self.refused = taken, refused

    def finish(self, evaluate: Callable[[DataFrame], DataFrame]) -> int:
        """Settles the run's jobs and appends them to the log. evaluate: (request) of distinct unanswered requests to (request, answer).

        Returns the number of rows; raises Conflict if the log has changed since the run began. A request without an answer leaves its jobs pending.
        """
        known = self.owner.log().where("event = 'done'").groupBy("request").agg(F.min("answer").alias("known"))
        rows = self.taken.select("job", "position", "request").join(known, "request", "left")
        asked = rows.where("known is null").groupBy("request").agg(F.min(F.struct("position", "job")).alias("first"))
        answers = evaluate(asked.select("request")).select("request", F.col("answer").alias("new"))
        rows = rows.join(asked, "request", "left").join(answers, "request", "left")
        mine = F.col("known").isNull() & (F.struct("position", "job") == F.col("first"))
        settled = rows.where("known is not null or new is not null").select("job", "position", "request", F.when(mine, "done").otherwise("cached").alias("event"), F.coalesce("known", "new").alias("answer"))
        refused = self.refused.select("job", "position", "request", F.lit("refused").alias("event"), F.lit(None).cast("string").alias("answer"))
        made = settled.union(refused).select(F.lit(self.number).alias("run"), "*", F.lit(self.number).alias("part"))
        version = self.manifest["version"]
        self.owner.store.commit({"log": (made, [self.number], ["position", "job"])}, version, self.owner._more(runs=self.number))
        return self.owner.store.read("log", [self.number]).count()
