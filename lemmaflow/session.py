"""Session helpers: durable checkpoints and table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. A machine-local folder is made only where none is named and the master is local."""
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lemmaflow-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def _drop(spark: SparkSession, folder: str) -> None:
    local = folder.removeprefix("file://").removeprefix("file:")
    if local.startswith("/") and os.path.isdir(local):
        shutil.rmtree(local, ignore_errors=True)
        return
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


_folders: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """A folder of this session's own below the checkpoint folder, removed when Python ends."""
    key = spark.sparkContext.applicationId
    if key not in _folders:
        _folders[key] = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lemmaflow-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _folders[key])
    return _folders[key]


def drop_scratch(spark: SparkSession) -> None:
    """Removes what cut_lineage has written in this session so far; for long sessions, between queries whose results are stored or no longer needed."""
    folder = _folders.get(spark.sparkContext.applicationId)
    if folder:
        _drop(spark, folder)




def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and go on from it: a lost executor loses nothing, each row is computed
    once, and later joins know the table's size."""
    folder = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
