from datetime import datetime as T

from lemmaflow.streaming import ledger

JOBS = "job_id string, job_target struct<leaf_id:string>, job_status string, queue_sequence long, updated_at timestamp"


def test_state_follows_the_files(spark, tmp_path):
    a = spark.createDataFrame([("j1", ("l",), "queued", 1, T(2025, 1, 1)), ("j2 ", ("l",), "queued", 2, T(2025, 1, 1)), (None, None, "queued", 3, T(2025, 1, 1))], JOBS)
    b = spark.createDataFrame([("j1", ("l",), "success", 1, T(2025, 1, 2)), ("j2", ("l",), "running", 2, T(2024, 1, 1))], JOBS)
    for df in (a, b):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ledger.follow(spark, str(tmp_path / "in"), a.schema, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    last = max((tmp_path / "state").iterdir(), key=lambda p: int(p.name.partition("=")[2]))
    assert {r.job_id: r.job_status for r in spark.read.parquet(str(last)).collect()} == {"j1": "success", "j2": "queued"}
    q = ledger.status_counts(spark, str(tmp_path / "in"), a.schema).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.job_status, r.n) for r in spark.table("counts").collect()} == {("queued", 2), ("success", 1), ("running", 1)}
