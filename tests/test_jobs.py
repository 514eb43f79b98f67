from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lemmaflow.functions.canon import group_hash
from lemmaflow.operators import jobs

SPAN = "source_span struct<file_path:string,start_line:int,start_column:int,end_line:int,end_column:int>"


def test_a_job_from_queue_to_result(spark):
    leaves = spark.createDataFrame([(i, "m", i, ("f.lean", 1, 1, 2, 2)) for i in ("b", "a", "c")], f"leaf_id string, module_path string, declaration_name string, {SPAN}")
    old = spark.createDataFrame([("job-000041", 7), ("other", 3)], "job_id string, queue_sequence long")
    now = datetime(2026, 1, 1)
    book = jobs.enqueue(leaves, old, lambda path: jobs.contract("/src/", "rev", path, "4.0", env={"B": "2", "A": "1"}), now)
    assert [(r.job_id, r.queue_sequence, r.job_target.leaf_id) for r in jobs.in_order(book).collect()] == [("job-000042", 8, "a"), ("job-000043", 9, "b"), ("job-000044", 10, "c")]
    assert jobs.problems(book).count() == 0
    outcomes = iter([{"exit_code": 0, "duration_ms": 5.4, "stdout": "one\n\n two \r\nthree", "stderr": "E1"}, {"exit_code": 0, "duration_ms": 1, "timed_out": True}])

    def run(job):
        assert job["reproducibility"]["args"] == ["env", "lean", "f.lean"]
        return next(outcomes)

    first = jobs.run_next(book, run, lambda: now, most=3)
    done = {r.job_id: r for r in first.collect()}["job-000042"]
    assert done.job_status == "success" and [tuple(x) for x in done.logs] == [(0, "stdout", "one"), (1, "stderr", "E1"), (2, "system", "Truncated 2 log lines.")] and tuple(done.job_result) == (0, None, 5, True, 4)
    second = jobs.run_next(first, run, lambda: now)
    third = jobs.run_next(second, run, lambda: now)  # the runner has no more outcomes: its error is the job's
    states = {r.job_id: (r.job_status, [x.message for x in r.logs]) for r in third.collect()}
    assert states["job-000043"] == ("timeout", []) and states["job-000044"][0] == "failure" and states["job-000044"][1][0].startswith("Runner error:")
    assert jobs.run_next(third, run, lambda: now) is None and jobs.problems(third).count() == 0
    for job_id in ("job-000042", "nobody"):
        with pytest.raises(ValueError):
            jobs.started(third, job_id, now)
    lines = [r.line for r in jobs.job_lines(third).where("job_id = 'job-000042'").orderBy("part").collect()]
    assert "env=A=1\x1fB=2" in lines[0] and "created_at=2026-01-01T00:00:00.000Z" in lines[0] and lines[1] == 'log[0]=stdout:"one"'
    assert group_hash(jobs.job_lines(third), ["job_id"], ["part"]).count() == 3


def test_caps(spark):
    df = spark.createDataFrame([([(5, "stdout", "a"), (6, "stderr", "b"), (9, "stdout", "c")],)], f"logs {jobs.LOG}")
    cap = lambda n: [tuple(x) for x in df.select(jobs.capped_logs(F.col("logs"), n)).first()[0]]
    assert cap(3) == [(5, "stdout", "a"), (6, "stderr", "b"), (9, "stdout", "c")] and cap(2) == [(0, "stdout", "a"), (1, "system", "Truncated 2 log lines.")]
    assert cap(1) == [(0, "system", "Truncated 3 log lines.")] and cap(0) == [(0, "system", "Truncated 3 log lines.")]
