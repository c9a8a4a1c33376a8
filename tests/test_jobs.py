import pytest
from pyspark.sql import functions as F

from tomeforge.operators.joblog import JobLog
from tomeforge.sources.versions import Conflict


def frames(spark, jobs, now=None):
    rows = spark.createDataFrame([(j, j, r, "s") for j, r in jobs.items()], "job long, position long, request string, source_sha256 string")
    return rows, spark.createDataFrame([(j, (now or {}).get(j, "s")) for j in jobs], "job long, sha256 string")


def answers(asked):
    return asked.where("request != 'silent'").select("request", F.upper("request").alias("answer"))


def events(held):
    return sorted((r.run, r.job, r.event, r.answer) for r in held.log().collect())


def test_runs_resume_in_order_and_by_cache(spark, tmp_path):
    held = JobLog(spark, str(tmp_path / "j"), 4)
    jobs, now = frames(spark, {1: "a", 2: "b", 3: "a", 4: "c", 5: "b", 6: "silent"}, {2: "other"})
    assert held.prepare(jobs) == 6 and held.prepare(jobs) == 0 and held.store.number() == 1
    assert held.begin(now, 2).finish(answers) == 3
    assert events(held) == [(1, 1, "done", "A"), (1, 2, "refused", None), (1, 3, "cached", "A")]
    assert held.begin(now, 0).finish(answers) == 0
    same = frames(spark, {1: "a", 2: "b", 3: "a", 4: "c", 5: "b", 6: "silent"})[1]
    assert held.begin(same).finish(answers) == 3
    assert events(held)[3:] == [(3, 2, "done", "B"), (3, 4, "done", "C"), (3, 5, "cached", "B")]
    assert [r.job for r in held.pending().collect()] == [6]
    again, _ = frames(spark, {3: "z", 7: "c"})
    assert held.prepare(again) == 2 and held.jobs().count() == 7
    assert held.begin(same.union(spark.createDataFrame([(7, "s")], same.schema))).finish(answers) == 2
    assert events(held)[6:] == [(4, 3, "done", "Z"), (4, 7, "cached", "C")]


def test_interleaved_runs_and_pause(spark, tmp_path):
    held = JobLog(spark, str(tmp_path / "j"))
    jobs, now = frames(spark, {i: f"r{i % 4}" for i in range(10)})
    held.prepare(jobs)
    one, two, three = held.begin(now, 3), held.begin(now, 5), held.begin(now)
    assert two.finish(answers) == 5
    for late in (one, three):
        with pytest.raises(Conflict):
            late.finish(answers)
    assert held.log().count() == 5
    held.pause()
    held.pause()
    assert held.begin(now).finish(answers) == 0
    held.pause(False)
    assert held.begin(now, 3).finish(answers) == 3 and held.begin(now).finish(answers) == 2
    assert [(e[1], e[2]) for e in events(held)] == [(i, "done" if i < 4 else "cached") for i in range(10)]
    assert held.pending().count() == 0 and held.log().groupBy("job").count().where("count > 1").count() == 0


def test_no_jobs(spark, tmp_path):
    held = JobLog(spark, str(tmp_path / "j"))
    jobs, now = frames(spark, {1: "a"})
    assert held.prepare(jobs.limit(0)) == 0 and held.begin(now).finish(answers) == 0 and held.log().count() == 0
