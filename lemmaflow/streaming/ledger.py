"""The job ledger as a stream: job rows arrive as files, the present state of each job is kept in a table of versions.

Defined results: rows of null or blank job ids are left out; a job's state is its row updated last; deliveries of a batch twice
(after a restart) write the same version folder again, so nothing is doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lemmaflow.functions.ids import clean_id

STATE = ["leaf_id", "job_status", "queue_sequence", "updated_at"]


def events(jobs: DataFrame) -> DataFrame:
    return jobs.select(clean_id("job_id").alias("job_id"), clean_id("job_target.leaf_id").alias("leaf_id"), "job_status", "queue_sequence", "updated_at").where("job_id IS NOT NULL")


def latest(rows: DataFrame) -> DataFrame:
    """One row a job: the one updated last."""
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*STATE), F.struct("updated_at", "queue_sequence", "job_status")).alias("s")).select("job_id", "s.*")


def status_counts(spark: SparkSession, folder: str, schema: StructType, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Streaming counts a status and window of updated_at, rows later than `late` behind the watermark left out."""
    rows = events(spark.readStream.schema(schema).parquet(folder)).withWatermark("updated_at", late)
    return rows.groupBy(F.window("updated_at", window), "job_status").agg(F.count(F.lit(1)).alias("n"))


def follow(spark: SparkSession, folder: str, schema: StructType, state_folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps state_folder/version=<batch>: the state after each batch, from the one before and the batch's rows."""

    def merge(batch: DataFrame, number: int) -> None:
        new = batch
        if number > 0:
            new = batch.unionByName(spark.read.parquet(f"{state_folder}/version={number - 1}"))
        latest(new).write.mode("overwrite").parquet(f"{state_folder}/version={number}")

    source = events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
