"""Metric operators on small hand-made job/stage tables."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarkframe.operators import metrics as M


def test_stage_ordinals_hot_job_and_sparse_ids(spark):
    """Bucketed ordinals equal one window per job, also for a job holding
    most stages with sparse ids spread over many buckets."""
    rng = random.Random(1)
    rows = [("r", 1, sid) for sid in rng.sample(range(0, 50_000), 20_000)]
    rows += [("r", j, sid) for j in range(2, 300) for sid in rng.sample(range(0, 40), rng.randint(1, 10))]
    rows += [("s", 1, sid) for sid in range(5)]
    st = spark.createDataFrame(rows, "run string, job_id long, stage_id long")
    got = M.stage_ordinals(st, bucket=64)
    w = Window.partitionBy("run", "job_id").orderBy("stage_id")
    ref = st.withColumn("ordinal", (F.row_number().over(w) - 1).cast("int"))
    assert got.columns == ref.columns
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_stage_ordinals_window_partitions_bounded(spark):
    """The window adds up list sizes, one row per (job, id range); no list is longer than a range."""
    st = spark.createDataFrame([("r", 1, i) for i in range(100)], "run string, job_id long, stage_id long")
    out = M.stage_ordinals(st, bucket=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = [ln for ln in plan.splitlines() if "Window [" in ln]
    assert len(windows) == 1 and "sum(" in windows[0] and "_b" in windows[0] and "row_number" not in plan
    assert "Join" not in plan
    assert {r.ordinal: r.stage_id for r in out.collect()} == {i: i for i in range(100)}


def _job(job_id, group="g", execs=14, threads=70):
    return ("r", job_id, group, "", 0, 1000, execs, threads)


JOB = "run string, job_id long, group_id string, desc string, start long, end long, n_exec int, n_thread int"
STAGE = "run string, job_id long, stage_id long, attempt long, name string, num_tasks int, submission long, completion long"
TASK = ("run string, job_id long, stage_id long, attempt long, task_id long, executor_id string, duration long, "
        "launch long, finish long, getting_result long, run_ms long, cpu_ns long, gc_ms long, deser_ms long, "
        "deser_cpu_ns long, ser_ms long")


def _task(job, stage, attempt, task, cpu=10**9):
    return ("r", job, stage, attempt, task, "1", 2000, 0, 2000, 0, 1500, cpu, 10, 5, 10**6, 1)


def test_a_retried_stage_is_one_stage(spark):
    jobs = spark.createDataFrame([_job(1)], JOB)
    stages = spark.createDataFrame([("r", 1, 0, 0, "a", 2, 0, 10), ("r", 1, 0, 1, "a", 1, 20, 50),
                                    ("r", 1, 5, 0, "b", 1, 60, 70)], STAGE)
    tasks = spark.createDataFrame([_task(1, 0, 0, 1), _task(1, 0, 0, 2), _task(1, 0, 1, 3), _task(1, 5, 0, 4)], TASK)
    ordinals = {r.stage_id: (r.ordinal, r.attempt) for r in M.stage_ordinals(stages).collect()}
    assert ordinals == {0: (0, 1), 5: (1, 0)}
    assert M.task_series(jobs, stages, tasks).count() == 4 * 8
    summary = {(r.stage_id, r.attempt): (r.n_stages, r.num_tasks, r.n_tasks, r["name"], r.group_id)
               for r in M.stage_summary(jobs, stages, tasks).collect()}
    assert summary == {(0, 0): (2, 2, 2, "a", "g"), (0, 1): (2, 1, 1, "a", "g"), (5, 0): (2, 1, 1, "b", "g")}
    times = {r.stage_id: r.seconds for r in M.stage_time_by_ordinal(jobs, stages).where("subset = 'threads'").collect()}
    assert times == {0: 0.03, 5: 0.01}
    assert {r.stage_id: r.n_tasks for r in M.stage_totals(tasks).collect()} == {0: 3, 5: 1}


def test_jobs_without_tasks_stay_and_sums_do_not_overflow(spark):
    jobs = spark.createDataFrame([_job(1), _job(2), _job(3, group=""), _job(4, execs=7, threads=35)], JOB)
    tasks = spark.createDataFrame([_task(1, 0, 0, k, cpu=5 * 10**18) for k in range(2)], TASK)
    tot = {(r.job_id, r.subset): r.cpu_s for r in M.totals(jobs, tasks).collect()}
    assert tot == {(1, "threads"): 1e10, (1, "executors"): 1e10, (2, "threads"): 0.0, (2, "executors"): 0.0}
    eff = {r.job_id: r.cpu_eff for r in M.cpu_efficiency(jobs, tasks).collect()}
    assert eff == {1: 2.5e9, 2: None}
