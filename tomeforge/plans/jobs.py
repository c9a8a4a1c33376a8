"""Queries over jobs: supervised phases as a stream, and logs of requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeforge.operators.graph import own_folder
from tomeforge.operators.joblog import JobLog
from tomeforge.plans.base import query
from tomeforge.sources.versions import Conflict
from tomeforge.streaming import supervision
from tomeforge.streaming.jobs import PHASES

#: Hours without a row after which a job has stalled.
PATIENCE = 60
PHASE_LIST = "[" + ", ".join(f"'{p}'" for p in PHASES) + "]"

SUPERVISED_SQL = f"""
with k as (select user_id as job, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, epoch_ms(ts) as ms, case when event_type = 'error' and event_id % 89 = 0 then 'failed' when event_id % 211 = 0 then 'interrupted' when event_type = 'signup' and event_id % 3 > 0 then 'phase' else 'page' end as kind, 1 + event_id % 40 as n from events),
c as (select *, ms - lag(ms) over w as gap, coalesce(sum(case when kind = 'page' then n end) over (w rows between unbounded preceding and 1 preceding), 0) as pages, coalesce(sum(case when kind = 'phase' then 1 end) over (w rows between unbounded preceding and 1 preceding), 0) as phases from k window w as (partition by job order by seq)),
s as (select *, case when gap > {PATIENCE} * 3600000 then 'stalled' when kind in ('failed', 'interrupted') then kind when kind = 'phase' and phases = {len(PHASES) - 2} then 'complete' end as stop from c),
e as (select job, min(case when stop is not null then seq end) as stop_at, max(seq) as last from s group by job),
d as (select s.* from s join e using (job) where stop_at is null or seq < stop_at or seq = stop_at and stop <> 'stalled'),
t as (
    select job, seq, 'phase' as what, 0 as phase, 'running' as state, 0 as pages from s where seq = 0
    union all select job, seq, 'phase', phases + 1, case when stop = 'complete' then stop else 'running' end, pages from d where kind = 'phase'
    union all select job, seq, 'restart', phases, 'running', pages + n from d where kind = 'page' and (pages + n) // 96 > pages // 96
    union all select job, seq, 'end', phases, stop, pages from d where stop in ('failed', 'interrupted')
    union all select job, seq - 1, 'end', phases, stop, pages from s join e using (job) where stop = 'stalled' and seq = stop_at
    union all select job, seq, 'end', phases + case when kind = 'phase' then 1 else 0 end, 'stalled', pages + case when kind = 'page' then n else 0 end from s join e using (job) where stop_at is null and seq = last)
select job, cast(seq as bigint) as seq, what, {PHASE_LIST}[cast(phase as int) + 1] as phase, state, cast(pages as bigint) as pages, cast(pages // 96 as bigint) as restarts from t
"""


def journal(table):
    """`events` as the journals of their users' jobs."""
    i = F.col("event_id")
    kind = F.when((F.col("event_type") == "error") & (i % 89 == 0), "failed").when(i % 211 == 0, "interrupted").when((F.col("event_type") == "signup") & (i % 3 > 0), "phase").otherwise("page")
    rows = table("events").select(F.col("user_id").alias("job"), "ts", "event_id", kind.alias("kind"), (1 + i % 40).alias("pages"))
    return supervision.numbered(rows, ["ts", "event_id"]).select("job", "seq", "ts", "kind", "pages")


@query(SUPERVISED_SQL)
def supervised_jobs(table, spark):
    """Phases, worker restarts and ends of jobs, by a stream with state and timers, run twice over a journal that grows."""
    rows, folder = journal(table), own_folder(spark, "supervised")
    month = table("events").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    half = month["first"] + (month["last"] - month["first"]) / 2
    span = f"{(month['last'] - month['first']).days + 1} days"  # the files of one write come in any order
    run = lambda: supervision.supervise(spark, f"{folder}/journal", folder, PATIENCE * 3_600_000, span, files_a_batch=4)
    rows.where(F.col("ts") < F.lit(half)).write.parquet(f"{folder}/journal")
    run()
    clock = spark.range(1).select(F.lit(-1).cast("long"), F.lit(0).cast("long"), F.expr(f"timestamp'{month['last']}' + interval {span} + interval {PATIENCE + 1} hours"), F.lit("clock"), F.lit(None).cast("long"))
    rows.where(F.col("ts") >= F.lit(half)).write.mode("append").parquet(f"{folder}/journal")
    run()
    clock.toDF("job", "seq", "ts", "kind", "pages").write.mode("append").parquet(f"{folder}/journal")
    return run()


#: Jobs that the first two runs take.
FIRST, SECOND = 300, 200
JOBLOG_SQL = f"""
with j as (select doc_id as job, doc_id as position, sha256(coalesce(lang, '') || '|' || coalesce(source, '') || '|' || (doc_id % 60)) as request, sha256('new|' || doc_id) as other, doc_id % 31 = 0 as renewed, doc_id % 29 = 0 as changed from documents),
t1 as (select *, row_number() over (order by position) as k from j where not changed), l1 as (select max(position) as stop from t1 where k <= {FIRST}),
r1 as (select 1 as run, job, position, request, case when row_number() over (partition by request order by position) = 1 then 'done' else 'cached' end as event from t1 where k <= {FIRST}
    union all select 1, job, position, request, 'refused' from j where changed and ((select count(*) from t1) < {FIRST} or position < (select stop from l1))),
j2 as (select job, position, case when renewed then other else request end as request, changed from j),
p2 as (select * from j2 where not exists (select 1 from r1 where r1.job = j2.job and r1.request = j2.request and event <> 'refused')),
t2 as (select *, row_number() over (order by position) as k from p2 where not changed), l2 as (select max(position) as stop from t2 where k <= {SECOND}),
r2 as (select 2 as run, job, position, request, case when request not in (select request from r1 where event = 'done') and row_number() over (partition by request order by position) = 1 then 'done' else 'cached' end as event from t2 where k <= {SECOND}
    union all select 2, job, position, request, 'refused' from p2 where changed and ((select count(*) from t2) < {SECOND} or position < (select stop from l2))),
p3 as (select * from p2 where not exists (select 1 from r2 where r2.job = p2.job and r2.request = p2.request and event <> 'refused')),
r3 as (select 3 as run, job, position, request, case when request not in (select request from r1 where event = 'done' union all select request from r2 where event = 'done') and row_number() over (partition by request order by position) = 1 then 'done' else 'cached' end as event from p3)
select run::int as run, job, event, case when event <> 'refused' then 'answer ' || request end as answer from (from r1 union all from r2 union all from r3)
"""


@query(JOBLOG_SQL)
def job_log(table, spark):
    """I8: three runs over jobs, the second begun while the first goes on; renewed requests, changed sources and a pause between."""
    d = F.col("doc_id")
    request = F.sha2(F.concat_ws("|", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), (d % 60).cast("string")), 256)
    renewed = F.when(d % 31 == 0, F.sha2(F.concat(F.lit("new|"), d.cast("string")), 256)).otherwise(request)
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    job = lambda r: table("documents").select(d.alias("job"), d.alias("position"), r.alias("request"), sha.alias("source_sha256"))
    now = table("documents").select(d.alias("job"), sha.alias("sha256"))
    changed = now.withColumn("sha256", F.when(F.col("job") % 29 == 0, "changed").otherwise(F.col("sha256")))
    answer = lambda asked: asked.select("request", F.concat(F.lit("answer "), "request").alias("answer"))
    held = JobLog(spark, own_folder(spark, "jobs"))
    held.prepare(job(request))
    one, two = held.begin(changed, FIRST), held.begin(changed, SECOND)
    one.finish(answer)
    try:
        two.finish(answer)
    except Conflict:  # the log has changed since it began
        held.prepare(job(renewed))
        held.begin(changed, SECOND).finish(answer)
    held.pause()
    if held.begin(now).taken.isEmpty():
        held.pause(False)
    held.begin(now).finish(answer)
    return held.log().select("run", "job", "event", "answer")
