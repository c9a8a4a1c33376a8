"""Supervised corpus jobs as a stream: phases, worker restarts, terminal states and jobs without progress.

A journal has rows (job, seq, ts, kind, pages): `page` commits pages, `phase` ends the present phase,
`failed` and `interrupted` end the job, `clock` only moves the time. seq counts a job's rows from 0 without gaps, so
that rows may arrive in any order and more than once: a row waits in state until those before it have come. A job
that isn't ended and has no row for `patience` after its last one has stalled: that is seen when its next row comes, or by
an event-time timer when the watermark passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tomeforge.streaming.jobs import PHASES, run_available

#: Committed pages after which a worker is replaced (a fixed value).
WORKER_PAGES = 96
JOURNAL = "job long, seq long, ts timestamp, kind string, pages long"
TRANSITIONS = "job long, seq long, what string, phase string, state string, pages long, restarts long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Supervisor(StatefulProcessor):
    """Transitions of each job: `phase` when one begins, `restart` when a worker has committed its pages, `end` with the state."""

    def __init__(self, patience_ms: int, worker_pages: int = WORKER_PAGES):
        self.patience_ms, self.worker_pages = patience_ms, worker_pages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "next long, at long, phase int, pages long, state string")
        self.waiting = handle.getMapState("waiting", "seq long", "at long, kind string, pages long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job = self.job.get() if self.job.exists() else (0, 0, 0, 0, "new")
        come: dict[int, tuple] = {}
        for frame in rows:
            frame = frame[frame["kind"] != "clock"]
            ms = frame["ts"].astype("datetime64[us]").astype("int64") // 1000
            come |= {s: (at, k, p) for s, at, k, p in zip(frame["seq"].tolist(), ms.tolist(), frame["kind"].tolist(), frame["pages"].fillna(0).astype("int64").tolist(), strict=True) if s >= job[0]}
        out: list[tuple] = []
        while job[4] in ("new", "running"):
            seq = job[0]
            if seq in come:
                row = come.pop(seq)
            elif self.waiting.containsKey((seq,)):
                row = tuple(self.waiting.getValue((seq,)))
                self.waiting.removeKey((seq,))
            else:
                break
            job = self._next(key[0], job, row, out)
        if job[4] in ("new", "running"):
            for seq, row in come.items():
                self.waiting.updateValue((seq,), row)
        else:
            self.waiting.clear()
        if job[4] != "new":
            self.job.update(job)
            self._wake(job)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRANSITIONS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job, out = self.job.get(), []
        # rows that are still missing are later than the watermark, or were dropped as too late: either way no progress
        if job[4] == "running" and expiredTimerInfo.getExpiryTimeInMs() >= job[1] + self.patience_ms:
            self.job.update(self._ended(key[0], job, job[0] - 1, "stalled", out))
            self.waiting.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRANSITIONS.split(", ")])

    def close(self) -> None:
        pass

    def _wake(self, job: tuple) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if job[4] == "running":
            self.handle.registerTimer(job[1] + self.patience_ms)

    def _ended(self, key, job: tuple, seq: int, state: str, out: list) -> tuple:
        out.append((key, seq, "end", PHASES[job[2]], state, job[3], job[3] // self.worker_pages))
        return (*job[:4], state)

    def _next(self, key, job: tuple, row: tuple, out: list) -> tuple:
        """The job after its next row."""
        seq, before, phase, pages, state = job
        at, kind, more = row
        say = lambda what, phase, state, pages: out.append((key, seq, what, PHASES[phase], state, pages, pages // self.worker_pages))
        if state == "new":
            say("phase", 0, "running", 0)
        elif at - before > self.patience_ms:
            return self._ended(key, job, seq - 1, "stalled", out)
        job = (seq + 1, at, phase, pages, "running")
        if kind in ("failed", "interrupted"):
            return self._ended(key, job, seq, kind, out)
        if kind == "phase":
            phase += 1
            done = phase == len(PHASES) - 1
            say("phase", phase, "complete" if done else "running", pages)
            return (seq + 1, at, phase, pages, "complete" if done else "running")
        if kind == "page" and (pages + more) // self.worker_pages > pages // self.worker_pages:
            say("restart", phase, "running", pages + more)
        return (seq + 1, at, phase, pages + (more if kind == "page" else 0), "running")


def supervised(journal: DataFrame, patience_ms: int, late: str, worker_pages: int = WORKER_PAGES) -> DataFrame:
    """TRANSITIONS of a streaming journal; rows that are `late` behind the newest one are dropped."""
    rows = journal.withWatermark("ts", late).groupBy("job")
    return rows.transformWithStateInPandas(Supervisor(patience_ms, worker_pages), TRANSITIONS, "Append", "EventTime")


def supervise(spark: SparkSession, journal: str, folder: str, patience_ms: int, late: str, files_a_batch: int = 96, worker_pages: int = WORKER_PAGES) -> DataFrame:
    """Runs over what has arrived of a journal's Parquet files, and gives all transitions so far, of earlier runs too.

    State, the files that are done and each batch's rows are kept under `folder`; a run that was stopped is
    taken up with the batch that it was in, whose rows replace what it had written of them.
    """
    given = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", files_a_batch).parquet(journal)
        found = supervised(stream, patience_ms, late, worker_pages)
        run_available(found, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/transitions/batch={n}"), f"{folder}/checkpoint")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", given)
    return spark.read.schema(TRANSITIONS).parquet(f"{folder}/transitions").select(*(c.split()[0] for c in TRANSITIONS.split(", ")))


def numbered(journal: DataFrame, order: list[str]) -> DataFrame:
    """The journal with seq: the place of each row among its job's."""
    from pyspark.sql import Window

    return journal.withColumn("seq", F.row_number().over(Window.partitionBy("job").orderBy(*order)).cast("long") - 1)
