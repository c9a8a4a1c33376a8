import datetime as dt
import random

import pytest

from tomeforge.streaming import jobs, supervision

START, HOUR = dt.datetime(2024, 1, 1), 3_600_000
PATIENCE = 10 * HOUR


def followed(rows):
    """The transitions of one job's rows in order, as the journal's contract says."""
    out, phase, pages, last = [], 0, 0, None
    say = lambda seq, what, state: out.append((seq, what, jobs.PHASES[phase], state, pages, pages // 96))
    for seq, (ts, kind, more) in enumerate(rows):
        if last is None:
            say(0, "phase", "running")
        elif ts - last > dt.timedelta(milliseconds=PATIENCE):
            break
        last = ts
        if kind in ("failed", "interrupted"):
            say(seq, "end", kind)
            return out
        if kind == "phase":
            phase += 1
            say(seq, "phase", "complete" if phase == 5 else "running")
            if phase == 5:
                return out
        else:
            before, pages = pages, pages + more
            if pages // 96 > before // 96:
                say(seq, "restart", "running")
        done = seq
    say(done, "end", "stalled")
    return out


def made(seed, n=25):
    """Jobs of every kind: complete, failed, interrupted, with a gap, and open at the end."""
    rng, found = random.Random(seed), {}
    for job in range(n):
        ts, rows = START, []
        for _ in range(rng.randrange(1, 30)):
            ts += dt.timedelta(hours=rng.choice([0, 1, 2, 5, 10, 11] if job % 4 == 0 else [0, 1, 2]))
            rows.append((ts, rng.choices(["page", "phase", "failed", "interrupted"], [20, 8, 1 if job % 5 == 1 else 0, 1 if job % 5 == 2 else 0])[0], rng.randrange(0, 120)))
        found[job] = rows
    return found


def written(spark, rows, path):
    spark.createDataFrame(rows, supervision.JOURNAL).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_stream_that_is_killed_and_run_again(spark, tmp_path, monkeypatch, seed):
    found = made(seed)
    rows = [(job, seq, *row) for job, own in found.items() for seq, row in enumerate(own)]
    random.Random(seed).shuffle(rows)  # rows of a job come in any order, some twice
    for at in range(0, len(rows), 60):
        written(spark, rows[at : at + 60] + rows[:5], str(tmp_path / "journal"))
    run = lambda: supervision.supervise(spark, str(tmp_path / "journal"), str(tmp_path / "out"), PATIENCE, "900 hours", files_a_batch=1)
    given, seen = supervision.run_available, []

    def killed(stream, each, checkpoint):
        def dying(batch, n):
            each(batch, n)
            seen.append(n)
            if len(seen) in (3, 5):
                raise RuntimeError("killed")

        given(stream, dying, checkpoint)

    monkeypatch.setattr(supervision, "run_available", killed)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            run()
    run()
    assert any(a >= b for a, b in zip(seen, seen[1:], strict=False)), "a batch is made again"
    written(spark, [(-1, 0, START + dt.timedelta(hours=2000), "clock", None)], str(tmp_path / "journal"))
    got = {}
    for r in run().collect():
        got.setdefault(r.job, []).append(tuple(r)[1:])
    order = lambda rows: sorted(rows, key=lambda r: (r[0], r[1] != "phase", r[1] == "end", r[4]))
    assert {j: order(r) for j, r in got.items()} == {j: order(followed(r)) for j, r in found.items()}
    states = {r[3] for own in got.values() for r in own}
    assert states >= {"running", "complete", "stalled"} and states & {"failed", "interrupted"}


def test_a_job_stalls_when_the_watermark_passes(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    run = lambda: sorted(tuple(r) for r in supervision.supervise(spark, str(tmp_path / "j"), str(tmp_path / "o"), PATIENCE, "1 hour").collect())
    written(spark, [(1, 0, at(0), "page", 96), (2, 1, at(1), "page", 1)], str(tmp_path / "j"))
    first = run()
    assert first == [(1, 0, "phase", "native-conversion", "running", 0, 0), (1, 0, "restart", "native-conversion", "running", 96, 1)]
    written(spark, [(3, 0, at(30), "phase", None)], str(tmp_path / "j"))
    assert (1, 0, "end", "native-conversion", "stalled", 96, 1) in run()
    written(spark, [(1, 1, at(31), "page", 500), (3, 1, at(31), "failed", None)], str(tmp_path / "j"))  # an ended job takes no more rows
    got = run()
    assert [r for r in got if r[0] == 1] == sorted([*first, (1, 0, "end", "native-conversion", "stalled", 96, 1)])
    assert (3, 1, "end", "publishing-native", "failed", 0, 0) in got and not [r for r in got if r[0] == 2]
