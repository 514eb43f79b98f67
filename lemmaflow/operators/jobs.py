"""Jobs that check declarations: the ledger and its rules, the queue, states, collected logs, contracts, canonical texts.

Running a job is left to a callable on the driver; nothing is spawned from executors. Defined results: of repeated rows of a job the one updated last counts; a null or blank job_id makes no job; a ledger is a table with
one row a job; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.functions.canon import json_text
from lemmaflow.functions.groups import ranked
from lemmaflow.functions.ids import clean_id, clean_ids
from lemmaflow.operators.leaf import span_text

#: States of a job, streams of its log, the version of the layout, defaults.
STATES, STREAMS, SCHEMA_VERSION = ["queued", "running", "success", "failure", "timeout"], ["stdout", "stderr", "system"], "1.0.0"
TIMEOUT_MS, LOG_LINES = 120_000, 400
LOG = "array<struct<line_index:int,stream_name:string,message:string>>"


def ledger(jobs: DataFrame) -> DataFrame:
    """The whole row of each job, as it was updated last; job_id and the leaf's id trimmed. Of equal times, the row with the larger state, then the larger text, counts."""
    rows = jobs.withColumn("job_id", clean_id("job_id")).where("job_id IS NOT NULL")
    cols = [c for c in rows.columns if c != "job_id"]
    order = F.struct(F.col("updated_at"), F.col("job_status"), F.xxhash64(*(F.to_json(F.struct(c)) for c in ("job_target", "logs", "job_result"))))
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*cols), order).alias("v")).select("job_id", "v.*")


def problems(job: DataFrame) -> DataFrame:
    """job_id, code of rows that break the ledger's rules: unknown_status, queued_with_run, running_without_start, finished_without_result, bad_timeout, missing_leaf, missing_command, unknown_stream, blank_message."""
    s, done = F.col("job_status"), F.col("job_status").isin("success", "failure", "timeout")
    blank = lambda c: clean_id(c).isNull()
    logs = F.coalesce("logs", F.array().cast(LOG))
    rules = [
        ("unknown_status", ~F.coalesce(s.isin(*STATES), F.lit(False))),
        ("queued_with_run", (s == "queued") & (F.col("started_at").isNotNull() | F.col("finished_at").isNotNull() | F.col("job_result").isNotNull())),
        ("running_without_start", (s == "running") & F.col("started_at").isNull()),
        ("finished_without_result", done & (F.col("finished_at").isNull() | F.col("job_result").isNull())),
        ("bad_timeout", F.coalesce(F.col("timeout_ms") <= 0, F.lit(True))),
        ("missing_leaf", blank(F.col("job_target.leaf_id"))),
        ("missing_command", blank(F.col("reproducibility.command_line"))),
        ("unknown_stream", F.exists(logs, lambda x: x.isNotNull() & ~F.coalesce(x["stream_name"].isin(*STREAMS), F.lit(False)))),
        ("blank_message", F.exists(logs, lambda x: x.isNotNull() & clean_id(x["message"]).isNull())),
    ]
    return job.select("job_id", F.explode(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules)), lambda x: x.isNotNull())).alias("code"))


def in_order(job: DataFrame) -> DataFrame:
    """Jobs by queue_sequence and id."""
    return job.orderBy("queue_sequence", "job_id")


def next_job_number(job: DataFrame) -> int:
    """One more than the largest number among ids of the form job-<digits>."""
    n = job.select(F.max(F.regexp_extract("job_id", r"^job-(\d+)$", 1).try_cast("bigint"))).first()[0]
    return (n or 0) + 1


def target_of(leaf: DataFrame) -> Column:
    """The target struct of leaf-shaped rows."""
    url = clean_id("source_url") if "source_url" in leaf.columns else F.lit(None).cast("string")
    return F.struct("leaf_id", F.col("leaf_id").alias("declaration_id"), "module_path", "declaration_name", "source_span", url.alias("source_url"))


def contract(root: str, revision: str, path: Column, lean_version: str, lake_version: str | None = None, command: str = "lake", prefix: tuple[str, ...] = ("env", "lean"), env: dict[str, str] | None = None) -> Column:
    """What a run needs to be repeated: the command over one file below root."""
    pairs = [F.lit(x) for k in sorted(env or {}) for x in (k, env[k])]
    tools = F.struct(F.lit(lean_version).alias("lean_version"), F.lit(lake_version).cast("string").alias("lake_version"))
    kept = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(revision).alias("source_revision"), F.lit(root.rstrip("/") or "/").alias("working_directory"), F.lit(command).alias("command_line"), F.array(*map(F.lit, prefix), F.trim(path)).alias("args"), kept.alias("env"), tools.alias("toolchain"))


def enqueue(leaf: DataFrame, job: DataFrame, contract_of: Callable[[Column], Column], now: datetime, timeout_ms: int = TIMEOUT_MS) -> DataFrame:
    """New queued jobs of leaf-shaped rows, in order of their ids: numbers and sequences go on from the ledger's largest ones."""
    first, last = next_job_number(job), job.agg(F.max("queue_sequence")).first()[0]
    start = 0 if last is None else last + 1
    rows = ranked(leaf, ["leaf_id"], "_place")
    when = F.lit(now).cast("timestamp")
    number = (F.lit(first) + F.col("_place")).cast("string")
    job_id = F.concat(F.lit("job-"), F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number))
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), job_id.alias("job_id"), (F.lit(start) + F.col("_place")).cast("long").alias("queue_sequence"), F.lit("queued").alias("job_status"), target_of(leaf).alias("job_target"), contract_of(F.col("source_span.file_path")).alias("reproducibility"),
        F.lit(timeout_ms).cast("long").alias("timeout_ms"), when.alias("created_at"), when.alias("updated_at"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.array().cast(LOG).alias("logs"),
        F.lit(None).cast("struct<exit_code:int,signal_name:string,duration_ms:bigint,logs_truncated:boolean,log_line_count:int>").alias("job_result"),
    )


def started(job: DataFrame, job_id: str, now: datetime) -> DataFrame:
    """The ledger with one queued job running; any other state is an error."""
    state = job.where(F.col("job_id") == job_id).select("job_status").first()
    if state is None:
        raise ValueError(f"job '{job_id}' does not exist")
    if state[0] != "queued":
        raise ValueError(f"job '{job_id}' is not queued (current status: {state[0]})")
    mine, when = F.col("job_id") == job_id, F.lit(now).cast("timestamp")
    return job.withColumns({"job_status": F.when(mine, "running").otherwise(F.col("job_status")), "started_at": F.when(mine, when).otherwise(F.col("started_at")), "updated_at": F.when(mine, when).otherwise(F.col("updated_at"))})


def _lines(c: Column) -> Column:
    """Trimmed lines of an output, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def collected_logs(stdout: Column, stderr: Column) -> Column:
    """The lines of both outputs by turns, those of stdout first, numbered from 0."""
    a, b = _lines(stdout), _lines(stderr)
    both = F.flatten(F.transform(F.arrays_zip(a.alias("o"), b.alias("e")), lambda z: F.filter(F.array(F.struct(F.lit("stdout").alias("s"), z["o"].alias("m")), F.struct(F.lit("stderr").alias("s"), z["e"].alias("m"))), lambda x: x["m"].isNotNull())))
    return F.transform(both, lambda x, i: F.struct(i.alias("line_index"), x["s"].alias("stream_name"), x["m"].alias("message")))


def capped_logs(logs: Column, most: int = LOG_LINES) -> Column:
    """The first lines, numbered anew, and a mark that says how many are left out, if there are more than `most`; else the lines as they are."""
    mark = lambda kept, i: F.struct(i.alias("line_index"), F.lit("system").alias("stream_name"), F.format_string("Truncated %d log lines.", F.size(logs) - kept).alias("message"))
    if most <= 0:
        return F.array(mark(F.lit(0), F.lit(0)))
    kept = F.transform(F.slice(logs, 1, most - 1), lambda x, i: F.struct(i.alias("line_index"), x["stream_name"].alias("stream_name"), x["message"].alias("message"))) if most > 1 else F.array().cast(LOG)
    return F.when(F.size(logs) > most, F.array_append(kept, mark(F.lit(most - 1), F.lit(most - 1)))).otherwise(logs)


def finished(job: DataFrame, outputs: DataFrame, now: datetime, most: int = LOG_LINES) -> DataFrame:
    """The ledger with the running jobs of outputs done: (job_id, exit_code, signal_name, duration_ms, timed_out, stdout, stderr, error). A timeout goes before the exit code; an error of the runner is a failure with one line."""
    o = outputs.select("job_id", *(F.col(c).alias(f"_{c}") for c in ("exit_code", "signal_name", "duration_ms", "timed_out", "stdout", "stderr", "error")))
    j = job.join(o, "job_id", "left")
    mine = (F.col("job_status") == "running") & (F.col("_duration_ms").isNotNull() | F.col("_error").isNotNull())
    failed = F.col("_error").isNotNull()
    whole = F.when(failed, F.array(F.struct(F.lit(0).alias("line_index"), F.lit("system").alias("stream_name"), F.concat(F.lit("Runner error: "), "_error").alias("message")))).otherwise(collected_logs(F.col("_stdout"), F.col("_stderr")))
    j = j.withColumn("_mine", F.coalesce(mine, F.lit(False))).withColumn("_lines", F.when(F.coalesce(mine, F.lit(False)), whole)).withColumn("_kept", capped_logs(F.col("_lines"), most))
    when = F.lit(now).cast("timestamp")
    state = F.when(failed, "failure").when(F.col("_timed_out"), "timeout").when(F.col("_exit_code") == 0, "success").otherwise("failure")
    result = F.struct(
        F.when(~failed, F.col("_exit_code")).cast("int").alias("exit_code"), F.when(~failed, F.col("_signal_name")).alias("signal_name"), F.when(failed, F.lit(0)).otherwise(F.round("_duration_ms")).cast("long").alias("duration_ms"),
        (F.size("_kept") < F.size("_lines")).alias("logs_truncated"), F.size("_lines").alias("log_line_count"),
    )
    new = {"job_status": state, "updated_at": when, "finished_at": when, "logs": F.col("_kept"), "job_result": result}
    types = dict(job.dtypes)
    return j.select(*(F.when(F.col("_mine"), new[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in job.columns))


def run_next(job: DataFrame, run: Callable[[dict], dict], clock: Callable[[], datetime], most: int = LOG_LINES) -> DataFrame | None:
    """The ledger after the first queued job was run by the callable (contract and timeout in, exit_code, signal_name, duration_ms, timed_out, stdout, stderr out); None if none is queued. One job at a time, on the driver."""
    first = job.where("job_status = 'queued'").orderBy("queue_sequence", "job_id").select("job_id", "reproducibility", "timeout_ms").first()
    if first is None:
        return None
    running = started(job, first["job_id"], clock())
    schema = "job_id string, exit_code int, signal_name string, duration_ms double, timed_out boolean, stdout string, stderr string, error string"
    try:
        o = run(first.asDict(recursive=True))
        row = (first["job_id"], o.get("exit_code"), o.get("signal_name"), float(o.get("duration_ms", 0)), bool(o.get("timed_out")), o.get("stdout"), o.get("stderr"), None)
    except Exception as e:  # noqa: BLE001  whatever the runner raises is the job's failure
        row = (first["job_id"], None, None, 0.0, False, None, None, str(e))
    return finished(running, job.sparkSession.createDataFrame([row], schema), clock(), most)


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def job_lines(job: DataFrame) -> DataFrame:
    """job_id, part, line: the canonical text of each job; hashed by canon.group_hash. Null elements of the log are left out."""
    t, r, res = F.col("job_target"), F.col("reproducibility"), F.col("job_result")
    logs = F.array_sort(F.filter(F.coalesce("logs", F.array().cast(LOG)), lambda x: x.isNotNull()), lambda a, b: F.when(a["line_index"] < b["line_index"], -1).when(a["line_index"] > b["line_index"], 1).otherwise(0))
    or_none = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    sep = "\x1f"
    env = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce(r["env"], F.create_map().cast("map<string,string>")))), lambda e: F.concat_ws("=", e["key"], e["value"])), sep)
    fields = {
        "schema": F.coalesce(clean_id("schema_version"), F.lit(SCHEMA_VERSION)), "job_id": F.col("job_id"), "queue_sequence": F.col("queue_sequence").cast("string"), "status": F.col("job_status"), "leaf_id": clean_id(t["leaf_id"]), "declaration_id": clean_id(t["declaration_id"]),
        "module_path": clean_id(t["module_path"]), "declaration_name": clean_id(t["declaration_name"]), "source_span": span_text(t["source_span"]), "source_url": or_none(clean_id(t["source_url"])), "timeout_ms": F.col("timeout_ms").cast("string"),
        "created_at": iso(F.col("created_at")), "updated_at": iso(F.col("updated_at")), "started_at": or_none(iso(F.col("started_at"))), "finished_at": or_none(iso(F.col("finished_at"))), "command": clean_id(r["command_line"]), "args": F.array_join(clean_ids(r["args"]), sep),
        "working_directory": clean_id(r["working_directory"]), "source_revision": clean_id(r["source_revision"]), "toolchain_lean": clean_id(r["toolchain"]["lean_version"]), "toolchain_lake": or_none(clean_id(r["toolchain"]["lake_version"])),
        "env": F.when(env == "", "none").otherwise(env), "result_exit_code": or_none(res["exit_code"]), "result_signal": or_none(res["signal_name"]), "result_duration_ms": or_none(res["duration_ms"]), "result_logs_truncated": or_none(res["logs_truncated"]),
        "result_log_line_count": or_none(res["log_line_count"]), "logs_count": F.size(logs).cast("string"),
    }
    head = F.concat_ws("\n", *(F.concat(F.lit(f"{n}="), F.coalesce(c, F.lit(""))) for n, c in fields.items()))
    line = lambda x: F.concat(F.lit("log["), F.coalesce(x["line_index"].cast("string"), F.lit("")), F.lit("]="), F.coalesce(x["stream_name"], F.lit("")), F.lit(":"), json_text(F.coalesce(x["message"], F.lit(""))))
    rows = job.select("job_id", head.alias("head"), F.transform(logs, line).alias("more"))
    return rows.select("job_id", F.posexplode(F.concat(F.array("head"), "more")).alias("part", "line"))
