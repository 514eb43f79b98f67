from lemmaflow.plans.queries import QUERIES


def test_logs_are_kept_up_to_the_references_default(spark, tmp_path):
    line = lambda i: (i, "stderr" if i % 3 else "stdout", f"m{i}")
    jobs = [(f"j{n}", [line(i) for i in reversed(range(n))]) for n in (30, 400, 401)]
    spark.createDataFrame(jobs, "job_id string, logs array<struct<line_index int, stream_name string, message string>>").write.parquet(f"{tmp_path}/verification_jobs.parquet")
    got = {}
    for r in QUERIES["log_interleave"](spark, str(tmp_path)).orderBy("job_id", "at").collect():
        got.setdefault(r.job_id, []).append((r.line_index, r.stream_name, r.message))
    assert got["j30"] == [line(i) for i in range(30)] and got["j400"] == [line(i) for i in range(400)]
    assert got["j401"] == [line(i) for i in range(399)] + [(399, "system", "Truncated 2 log lines.")]
