"""Metric reports over job / stage / task tables.

Tables are keyed by ``run`` (one event log or one labelled result file) and
``job_id``; tasks carry their ``job_id`` and ``stage_id``. Sums go task ->
stage -> job with map-side partial aggregation, so the joins that follow
(job-level metadata, stage ordinals) are between aggregated, one-row-per-key
tables.

Units: ``*_ns`` / 1e9 and ``*_ms`` / 1e3 give seconds (the reference divided
one millisecond total by 1e9; here every millisecond metric is / 1e3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import round_to
from .skew import PART_ROWS, join_in_parts, key_parts

# The run labels the reference's two scaling sweeps hold fixed.
FIXED_EXECUTORS = 14
FIXED_THREADS = 70

# metric -> (task column, divisor to seconds)
TOTALS = {
    "cpu_s": ("cpu_ns", 1e9),
    "run_s": ("run_ms", 1e3),
    "gc_s": ("gc_ms", 1e3),
    "deser_s": ("deser_ms", 1e3),
    "deser_cpu_s": ("deser_cpu_ns", 1e9),
    "ser_s": ("ser_ms", 1e3),
    "getting_result_s": ("getting_result", 1e3),
    "duration_s": ("duration", 1e3),
}

# per-task series of the distribution charts: name -> (SQL expression, divisor)
SERIES = {
    "duration": ("duration", 1e3),
    "finish_launch": ("finish - launch", 1e3),
    "getting_result": ("getting_result", 1e3),
    "exe_run": ("run_ms", 1e3),
    "cpu": ("cpu_ns", 1e9),
    "deser_cpu": ("deser_cpu_ns", 1e9),
    "deser": ("deser_ms", 1e3),
    "gc": ("gc_ms", 1e3),
}

KEY = ["run", "job_id"]
ORDINAL_BUCKET = 4096   # stage ids per range of the ordinal's prefix sum


def parallelism() -> Column:
    """M8: executors x threads of the run."""
    return (F.col("n_exec") * F.col("n_thread")).alias("parallelism")


def sweep_subsets(jobs: DataFrame, fixed_executors: int = FIXED_EXECUTORS,
                  fixed_threads: int = FIXED_THREADS) -> DataFrame:
    """F7 + F8 + A18: jobs with a group label, in the two sweeps.

    ``subset = 'threads'``: executors fixed, threads vary; ``'executors'``:
    threads fixed. The sweeps overlap, so a job may appear in both: its
    labels are exploded from one scan.
    """
    labels = F.array_compact(F.array(
        F.when(F.col("n_exec") == fixed_executors, F.lit("threads")),
        F.when(F.col("n_thread") == fixed_threads, F.lit("executors"))))
    return jobs.where(F.col("group_id") != "").withColumn("subset", F.explode(labels))


def _sums(cols: list[str]) -> list[Column]:
    """Integer sums that cannot overflow: DECIMAL(30, 0)."""
    return [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in cols]


_METRICS = sorted({c for c, _ in TOTALS.values()})


def _seconds(digits: int) -> list[Column]:
    """Every total in seconds; 0 without tasks."""
    return [F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / F.lit(d), digits).alias(name)
            for name, (c, d) in TOTALS.items()]


def stage_sums(tasks: DataFrame) -> DataFrame:
    """Per stage attempt, sums of every task metric and the task count."""
    return (tasks.groupBy(*KEY, "stage_id", "attempt")
            .agg(F.count(F.lit(1)).alias("n_tasks"), *_sums(_METRICS)))


def stage_totals(tasks: DataFrame, digits: int = 6) -> DataFrame:
    """Per stage (all its attempts), totals in seconds and task count."""
    s = tasks.groupBy(*KEY, "stage_id").agg(F.count(F.lit(1)).alias("n_tasks"), *_sums(_METRICS))
    return s.select(*KEY, "stage_id", "n_tasks", *_seconds(digits))


def job_sums(tasks: DataFrame) -> DataFrame:
    """Per job, sums of every task metric.

    The reference sums tasks per stage, then stages per job; integer sums do
    not depend on the grouping, so one partial/final aggregation per job
    gives the same numbers with one shuffle fewer."""
    return tasks.groupBy(*KEY).agg(*_sums(_METRICS))


def job_time(jobs: DataFrame) -> DataFrame:
    """K1/K2: job wall time (s) against parallelism, both sweeps."""
    s = sweep_subsets(jobs)
    return s.select("run", "subset", "group_id", "job_id", parallelism(),
                    F.round((F.col("end") - F.col("start")) / F.lit(1000.0), 3).alias("seconds"))


def cpu_efficiency(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Total CPU time over total task duration, per job; NULL for a
    job without tasks or without task time."""
    eff = F.try_divide(F.col("cpu_ns").cast("double") / F.lit(1e9), F.col("duration").cast("double") / F.lit(1e3))
    return (sweep_subsets(jobs).join(job_sums(tasks), KEY, "left")
            .select("run", "subset", "group_id", "job_id", parallelism(), F.round(eff, 6).alias("cpu_eff")))


def totals(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per-job totals of every metric (s), both sweeps; a job
    without tasks has zeros."""
    return (sweep_subsets(jobs).join(job_sums(tasks), KEY, "left")
            .select("run", "subset", "group_id", "job_id", parallelism(), *_seconds(6)))


def stage_ordinals(stages: DataFrame, bucket: int = ORDINAL_BUCKET) -> DataFrame:
    """Ordinal of each stage inside its job, by stage id, from 0.

    A prefix sum over ranges of stage ids, with no join of the stage table to
    itself: the stages of each (job, range of ``bucket`` ids) are collected in
    order; a window over a job's ranges (one row each, with its number of
    stages) adds up those before; the position in the range is added to that.
    No list holds more than ``bucket`` stage ids, and a window row stands for a
    whole range. A stage that was retried counts once (its last attempt).
    """
    rest = [c for c in stages.columns if c not in (*KEY, "stage_id", "attempt")]
    attempt = F.col("attempt") if "attempt" in stages.columns else F.lit(0).cast("long").alias("attempt")
    ranges = (stages.select(*KEY, F.floor(F.col("stage_id") / F.lit(bucket)).alias("_b"),
                            F.struct("stage_id", attempt, *rest).alias("_s"))
              .groupBy(*KEY, "_b").agg(F.sort_array(F.collect_list("_s")).alias("_all")))
    last = F.filter("_all", lambda s, i: ~F.coalesce(F.get(F.col("_all"), i + 1)["stage_id"] == s["stage_id"], F.lit(False)))
    before = Window.partitionBy(*KEY).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = (ranges.select(*KEY, "_b", last.alias("_last"))
              .withColumn("_off", F.coalesce(F.sum(F.size("_last")).over(before), F.lit(0))))
    cols = [F.col(f"_s.{c}").alias(c) for c in stages.columns if c not in KEY]
    out = placed.select(*KEY, "_off", F.posexplode("_last").alias("_pos", "_s")).select(
        *KEY, *cols, (F.col("_off") + F.col("_pos")).cast("int").alias("ordinal"))
    return out.select(*stages.columns, "ordinal")


def stage_time_by_ordinal(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """Stage wall time (s) by stage ordinal against parallelism."""
    so = stage_ordinals(stages)
    return (sweep_subsets(jobs).select("subset", "group_id", *KEY, parallelism())
            .join(so, KEY)
            .select("run", "subset", "group_id", "job_id", "parallelism", "ordinal", "stage_id",
                    F.round((F.col("completion") - F.col("submission")) / F.lit(1000.0), 3).alias("seconds")))


def task_series(jobs: DataFrame, stages: DataFrame, tasks: DataFrame, subset: str = "executors",
                most: int = PART_ROWS) -> DataFrame:
    """Eight per-task time series (s), keyed by executor and task id.

    One row per (task, series), i.e. the long form of the distribution
    charts; ``unpivot`` keeps it a single narrow projection. Tasks are joined
    once, to a row per stage that has its job's labels; a stage of more than
    ``most`` tasks (as declared) is met in parts.
    """
    j = sweep_subsets(jobs).where(F.col("subset") == subset).select("group_id", *KEY, "n_exec", "n_thread")
    key = [*KEY, "stage_id"]
    of_stage = stage_ordinals(stages.select(*key, *[c for c in stages.columns if c == "attempt"])).join(j, KEY).drop("attempt")
    hot = key_parts(stages.groupBy(*key).agg(F.sum("num_tasks").alias("n")), "n", most)
    t = tasks.select(*key, "executor_id", "task_id", "launch",
                     *[round_to(f"CAST({c} AS DOUBLE) / CAST('{d!r}' AS DOUBLE)", 6).alias(n)
                       for n, (c, d) in SERIES.items()])
    wide = join_in_parts(t, of_stage, key, hot, ["executor_id", "task_id", "launch"])
    long = wide.unpivot(["run", "group_id", "job_id", "n_exec", "n_thread", "ordinal", "executor_id", "task_id"],
                        list(SERIES), "series", "seconds")
    return long.select("run", "group_id", "job_id", "n_exec", "n_thread", "ordinal", "executor_id", "task_id",
                       "series", "seconds")


def stage_summary(jobs: DataFrame, stages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Group, stages per job, name, declared vs observed tasks of every
    stage attempt. A retried stage counts once among its job's stages."""
    obs = tasks.groupBy(*KEY, "stage_id", "attempt").agg(F.count(F.lit(1)).alias("n_tasks"))
    per_job = (stages.groupBy(*KEY, "stage_id").agg(F.lit(1).alias("one")).groupBy(*KEY)
               .agg(F.count(F.lit(1)).cast("int").alias("n_stages")).join(jobs.select(*KEY, "group_id"), KEY))
    return (stages.join(obs, KEY + ["stage_id", "attempt"], "left").join(per_job, KEY)
            .select("run", "group_id", "job_id", "stage_id", "attempt", "name", "n_stages", "num_tasks",
                    F.coalesce("n_tasks", F.lit(0)).alias("n_tasks")))
