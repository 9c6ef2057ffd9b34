"""Scheduler event logs derived from the driver's flat tables, so that the
event-log source runs over data that grows with the input.

The jobs, stages and tasks of ``metrics_tables`` are written as scheduler
events, one JSON line each, compressed, into rolled-log folders named after the
run labels (``application=eventlog_v2_<execs>_<threads>__tables``), beside files
with another suffix.
Jobs with ``o_custkey % 7 = 0`` have no job group, those with
``o_custkey % 11 = 0`` no completion time. Stage ids are unique in a log:
``8 * job_id + l_linenumber``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import derived_path, path_exists, publish
from .events import store_key, table
from .metrics_tables import jobs_from_orders, stages_from_lineitem, tasks_from_lineitem

LOG_VERSION = "v2"
STAGES_PER_JOB = 8
LINES_PER_FILE = 500_000     # a compressed file is read by one task


def _event(name: str, **fields: Column) -> Column:
    return F.to_json(F.struct(F.lit(name).alias("Event"), *[v.alias(k) for k, v in fields.items()])).alias("value")


def _events(orders: DataFrame, lineitem: DataFrame) -> list[DataFrame]:
    """application, value: the scheduler events of each kind as JSON lines. Rows
    are in order of their log before their lines are made, so that writing a
    folder for each log sorts no lines."""
    c = F.col
    keys = orders.selectExpr("o_orderkey AS job_id", "o_custkey AS cust")
    log = F.concat_ws("_", F.lit("eventlog_v2"), "n_exec", "n_thread", F.lit("_tables")).alias("application")
    jobs = jobs_from_orders(orders).join(keys, "job_id").select("*", log)
    of_job = jobs.select("job_id", "application")
    sid = c("job_id") * STAGES_PER_JOB + c("stage_id")
    group = F.when(c("cust") % 7 != 0, c("group_id"))
    by_log = lambda rows: rows.sortWithinPartitions("application")
    starts = by_log(jobs).select("application", _event("SparkListenerJobStart", **{
        "Job ID": c("job_id"), "Submission Time": c("start"),
        "Stage IDs": F.sequence(c("job_id") * STAGES_PER_JOB, c("job_id") * STAGES_PER_JOB + STAGES_PER_JOB - 1),
        "Properties": F.struct(group.alias("spark.jobGroup.id"), c("desc").alias("spark.job.description"))}))
    ends = by_log(jobs).select("application", _event("SparkListenerJobEnd", **{
        "Job ID": c("job_id"), "Completion Time": F.when(c("cust") % 11 != 0, c("end"))}))
    stages = by_log(stages_from_lineitem(lineitem, jobs).join(of_job, "job_id")).select(
        "application", _event("SparkListenerStageCompleted", **{"Stage Info": F.struct(
            sid.alias("Stage ID"), c("attempt").alias("Stage Attempt ID"), c("name").alias("Stage Name"),
            c("num_tasks").alias("Number of Tasks"), c("submission").alias("Submission Time"),
            c("completion").alias("Completion Time"))}))
    tasks = by_log(tasks_from_lineitem(lineitem).join(of_job, "job_id")).select(
        "application", _event("SparkListenerTaskEnd", **{
            "Stage ID": sid, "Stage Attempt ID": c("attempt"), "Task Type": c("task_type"),
            "Task Info": F.struct(
                c("task_id").alias("Task ID"), c("host").alias("Host"), c("executor_id").alias("Executor ID"),
                c("launch").alias("Launch Time"), c("finish").alias("Finish Time"),
                c("getting_result").alias("Getting Result Time")),
            "Task Metrics": F.struct(
                c("deser_ms").alias("Executor Deserialize Time"),
                c("deser_cpu_ns").alias("Executor Deserialize CPU Time"), c("run_ms").alias("Executor Run Time"),
                c("cpu_ns").alias("Executor CPU Time"), c("result_size").alias("Result Size"),
                c("gc_ms").alias("JVM GC Time"), c("ser_ms").alias("Result Serialization Time"))}))
    return [starts, ends, stages, tasks]


def event_logs(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the logs of ``sf_dir``, written on first use."""
    path = derived_path(spark, "logs", f"{LOG_VERSION}-{store_key(spark, sf_dir)}")
    if not path_exists(spark, path + "/done"):
        parent, name = path.rsplit("/", 1)
        tmp = f"{parent}/_building-{name}-{uuid.uuid4().hex[:12]}"
        for events in _events(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")):
            (events.write.mode("append").partitionBy("application").option("compression", "gzip")
             .option("maxRecordsPerFile", LINES_PER_FILE).text(tmp))
        spark.range(1).select(F.lit("not a log").alias("value")).write.text(f"{tmp}/done")
        publish(spark, tmp, path, marker="done")
    return path
