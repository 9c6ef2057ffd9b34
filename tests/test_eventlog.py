"""Job, stage and task tables read back from a real Spark event log."""

import json
import os
import pathlib
import shutil
import subprocess
import sys
from collections import Counter

from pyspark.sql import functions as F

from quarkframe.operators import metrics as M
from quarkframe.sources.eventlog import metrics_tables, read_event_log

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from quarkframe.session import local_session
s = local_session(cpus=2, shuffle_partitions=4, event_log_dir={logdir!r}, app="eventlog-test")
sc = s.sparkContext
sc.setJobGroup("B1.Q0", "count")
s.range(10000).repartition(4).selectExpr("id % 7 as k").groupBy("k").count().collect()
sc.setJobGroup("B2.Q0", "sum")
s.range(1000).selectExpr("sum(id)").collect()
sc.setLocalProperty("spark.jobGroup.id", None)
s.range(10).count()
s.stop()
"""


def test_event_log_tables(spark, tmp_path):
    logdir = tmp_path / "logs"
    logdir.mkdir()
    subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, logdir=str(logdir))],
                   check=True, timeout=600, capture_output=True)
    (log,) = os.listdir(logdir)
    runs = tmp_path / "runs"
    runs.mkdir()
    shutil.copy(logdir / log, runs / "14_70__eventlog.json")
    shutil.copy(logdir / log, runs / "7_70__eventlog.json")
    (runs / "notes.txt").write_text("not a log")

    t = metrics_tables(read_event_log(spark, str(runs), glob="*.json"))
    jobs = t["jobs"].collect()
    assert {j.run for j in jobs} == {"14_70__eventlog.json", "7_70__eventlog.json"}
    assert {(j.n_exec, j.n_thread) for j in jobs} == {(14, 70), (7, 70)}
    assert {"B1.Q0", "B2.Q0", ""} <= {j.group_id for j in jobs}
    assert all(j.end >= j.start > 0 for j in jobs)

    tasks = t["tasks"]
    assert tasks.count() > 0
    assert tasks.where(F.col("job_id").isNull()).count() == 0
    assert tasks.where(F.col("cpu_ns") <= 0).count() == 0

    # declared and observed task counts agree for every completed stage
    s = M.stage_summary(t["jobs"], t["stages"], tasks)
    assert s.where(F.col("num_tasks") != F.col("n_tasks")).count() == 0

    # reports run on event-log tables; the unlabelled job is dropped
    jt = M.job_time(t["jobs"]).collect()
    assert jt and all(r.group_id != "" for r in jt)
    assert {r.subset for r in jt} == {"threads", "executors"}
    tot = M.totals(t["jobs"], tasks).collect()
    assert tot and all(r.duration_s >= 0 for r in tot)
    eff = M.cpu_efficiency(t["jobs"], tasks).collect()
    assert eff
    so = M.stage_time_by_ordinal(t["jobs"], t["stages"]).collect()
    assert so and min(r.ordinal for r in so) == 0
    ser = M.task_series(t["jobs"], t["stages"], tasks).collect()
    assert len({r.series for r in ser}) == 8


ADAPTIVE = """
from pyspark.sql import SparkSession, functions as F
s = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
     .config("spark.sql.shuffle.partitions", "4").config("spark.eventLog.enabled", "true")
     .config("spark.eventLog.dir", {logdir!r}).getOrCreate())
s.sparkContext.setJobGroup("Q", "joined")
a = s.range(5000).groupBy((F.col("id") % 97).alias("k")).count()
b = s.range(3000).groupBy((F.col("id") % 89).alias("k")).count()
a.join(b.withColumnRenamed("count", "n"), "k").groupBy("n").count().collect()
s.stop()
"""


def test_default_logs_of_an_adaptive_query(spark, tmp_path):
    """Spark's defaults (rolled, compressed) below a common folder; the jobs
    that adaptive execution starts for one query are one job."""
    logdir = tmp_path / "logs"
    logdir.mkdir()
    subprocess.run([sys.executable, "-c", ADAPTIVE.format(logdir=str(logdir))], check=True, timeout=600,
                   capture_output=True)
    t = metrics_tables(read_event_log(spark, str(tmp_path)))
    (job,) = t["jobs"].where("group_id = 'Q'").collect()
    assert not job.run.startswith("eventlog_v2_") and job.end > job.start
    ordinals = {r.ordinal for r in M.stage_ordinals(t["stages"].where(F.col("job_id") == job.job_id)).collect()}
    assert len(ordinals) >= 2 and ordinals == set(range(len(ordinals)))
    assert t["tasks"].where(F.col("job_id").isNull()).count() == 0


def test_a_folder_without_events_is_an_error(spark, tmp_path):
    import pytest

    (tmp_path / "notes.json").write_text("not a log\n")
    with pytest.raises(ValueError, match="no scheduler event"):
        read_event_log(spark, str(tmp_path))


def test_nested_metrics_files(spark, tmp_path):
    """Maps of stages and tasks become rows; labels come from the file name,
    missing group and times are "" and -1, other suffixes are not read."""
    import json

    from quarkframe.sources.metrics_json import read_nested_metrics

    def task(k):
        return {"id": k, "host": "h", "executorId": str(k % 2), "duration": 1000, "taskType": "ResultTask",
                "launchTime": 5, "finishTime": 1005, "gettingResultTime": 0,
                "metrics": {"exeRunTime": 900, "exeCpuTime": 10**9 * k, "jvmGCTime": 1, "exeDeserializeTime": 2,
                            "exeDeserializeCpuTime": 3, "resultSerializationTime": 4, "resultSize": 5}}

    def stage(i, n):
        return {"id": i, "name": f"s{i}", "numTasks": n, "submissionTime": 0, "completionTime": 10,
                "tasks": {str(k): task(k) for k in range(n)}}

    jobs = [{"id": 0, "groupId": "q", "desc": "d", "startTime": 1, "endTime": 9,
             "stages": {"0": stage(0, 2), "1": stage(1, 3)}},
            {"id": 1, "startTime": 4, "stages": {}}]
    for name in ("14_70__a.json", "7_70__b.json", "notes.txt"):
        (tmp_path / name).write_text(json.dumps(jobs) + "\n")
    t = read_nested_metrics(spark, str(tmp_path))
    got = {(r.run, r.job_id): (r.group_id, r.start, r.end, r.n_exec, r.n_thread) for r in t["jobs"].collect()}
    assert got == {(f, j): (("q", 1, 9) if j == 0 else ("", 4, -1)) + (n, 70)
                   for f, n in (("14_70__a.json", 14), ("7_70__b.json", 7)) for j in (0, 1)}
    s = M.stage_summary(t["jobs"], t["stages"], t["tasks"]).collect()
    assert {(r.run, r.stage_id, r.n_stages, r.num_tasks, r.n_tasks) for r in s} == {
        (f, i, 2, n, n) for f in ("14_70__a.json", "7_70__b.json") for i, n in ((0, 2), (1, 3))}
    cpu = {(r.run, r.stage_id): r.cpu_s for r in M.stage_totals(t["tasks"]).collect()}
    assert cpu["14_70__a.json", 0] == 1.0 and cpu["7_70__b.json", 1] == 3.0


def test_preview_and_run_for_effect(spark, capsys):
    from quarkframe.sources.sinks import preview, run_for_effect

    preview(spark.range(3), 2)
    assert "only showing top 2 rows" in capsys.readouterr().out
    seen = spark.sparkContext.accumulator(0)
    run_for_effect(spark.range(10).rdd.map(lambda r: (seen.add(1), r)[1]).toDF("id long"))
    assert seen.value == 10


def _metric_rows(spark):
    """Labelled tables with a hot job, a retried stage, jobs without stages and stages without tasks."""
    jobs = [("14_70__a", j, f"g{j}", "d", 10 * j, 10 * j + 5, 14, 70) for j in range(4)] + [("7_35__b", 0, "", "", 1, -1, 7, 35)]
    stages, tasks = [], []
    for run, job, *_ in jobs[:3] + jobs[4:]:
        for st in range(30 if job == 1 else 2):
            for attempt in range(2 if (job, st) == (0, 1) else 1):
                n = 57 if job == 1 and st == 3 else 0 if st == 7 else 3
                stages.append((run, job, st, attempt, f"s{st}", n, st, st + 9))
                tasks += [(run, job, st, attempt, t // 2 if st == 1 else t, "h", str(t % 3), 5, "ResultTask", t, t + 5, 0,
                           *range(t, t + 13)) for t in range(n)]
    metrics = ["run_ms", "cpu_ns", "gc_ms", "deser_ms", "deser_cpu_ns", "ser_ms", "result_size", "disk_spill", "mem_spill",
               "bytes_read", "records_read", "bytes_written", "records_written"]
    return {
        "jobs": spark.createDataFrame(jobs, "run string, job_id bigint, group_id string, `desc` string, start bigint, "
                                            "`end` bigint, n_exec int, n_thread int"),
        "stages": spark.createDataFrame(stages, "run string, job_id bigint, stage_id bigint, attempt bigint, name string, "
                                                "num_tasks int, submission bigint, completion bigint"),
        "tasks": spark.createDataFrame(tasks, "run string, job_id bigint, stage_id bigint, attempt bigint, task_id bigint, "
                                              "host string, executor_id string, duration bigint, task_type string, "
                                              "launch bigint, finish bigint, getting_result bigint, "
                                              + ", ".join(f"{m} bigint" for m in metrics))}


def test_nested_metrics_round_trip_in_pieces(spark, tmp_path):
    """Pieces hold a bounded number of tasks and stages and read back as the same tables."""
    from quarkframe.sources.metrics_json import nested_jobs, read_nested_metrics, write_nested_metrics

    tables = _metric_rows(spark)
    for most in (10_000, 5):
        rows = nested_jobs(tables, most).collect()
        assert len([r for r in rows if r.run == "14_70__a" and r.id == 1]) > (1 if most == 5 else 0)
        largest = max(len(s.tasks) for r in rows for s in r.stages.values())
        assert largest == 57 if most == 10_000 else largest < 25
        path = write_nested_metrics(tables, str(tmp_path / f"m{most}"), most)
        (tmp_path / f"m{most}" / "other.txt").write_text('[{"id": 99}]')
        got = read_nested_metrics(spark, path)
        for t, want in tables.items():
            assert sorted(got[t].select(want.columns).collect()) == sorted(want.collect()), (t, most)


def test_nested_metrics_arrays_over_many_lines(spark, tmp_path):
    from quarkframe.sources.metrics_json import read_nested_metrics

    (tmp_path / "14_70__a.json").write_text('[\n {"id": 1, "groupId": "a]"},\n {"id": 2, "groupId": "[,b"}\n,{"id": 3}\n]\n')
    (tmp_path / "7_70__b.json").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "7_35__c.json").write_text('[{"id": 1},\n{"id": 2}]\n\n[]\n')
    (tmp_path / "1_1__d.json").write_text("")
    jobs = read_nested_metrics(spark, str(tmp_path))["jobs"].collect()
    assert {(r.run, r.job_id, r.group_id) for r in jobs} == {
        ("14_70__a.json", 1, "a]"), ("14_70__a.json", 2, "[,b"), ("14_70__a.json", 3, ""), ("7_70__b.json", 1, ""),
        ("7_70__b.json", 2, ""), ("7_35__c.json", 1, ""), ("7_35__c.json", 2, "")}


def test_ingest_partitions_records_and_sees_changed_logs(spark, tmp_path):
    import json

    import zstandard

    def lines(n):
        return "".join(json.dumps(x) + "\n" for x in (
            [{"Event": "SparkListenerLogStart"}, {"Event": "SparkListenerJobStart", "Job ID": 0, "Stage IDs": [0]}]
            + [{"Event": "SparkListenerTaskEnd", "Stage ID": 0, "Stage Attempt ID": 0, "Task Info": {"Task ID": i}}
               for i in range(n)])).encode()

    logs = tmp_path / "logs"
    (logs / "eventlog_v2_2_3__app").mkdir(parents=True)
    (logs / "eventlog_v2_2_3__app" / "events_1.zstd").write_bytes(
        zstandard.compress(lines(3)) + zstandard.compress(lines(0)[:0]))
    (logs / "14_70__plain").write_bytes(lines(2))
    records = read_event_log(spark, str(logs))
    assert {(r.event, r.run) for r in records.select("event", "run").distinct().collect()} == {
        (e, run) for e in ("job_start", "task") for run in ("2_3__app", "14_70__plain")}
    assert metrics_tables(records)["tasks"].where("job_id = 0").count() == 5
    (logs / "14_70__plain").write_bytes(lines(4))
    assert metrics_tables(read_event_log(spark, str(logs)))["tasks"].count() == 7


def test_a_hot_job_reaches_several_tasks(spark):
    """J4 without broadcast joins and without adaptive skew joins: a stage with a third of all tasks is joined in parts."""
    from quarkframe.operators.skew import join_in_parts, key_parts

    jobs = spark.range(200).selectExpr("'r' AS run", "id AS job_id", "'g' AS group_id", "14 AS n_exec", "70 AS n_thread",
                                       "1L AS start", "2L AS `end`")
    hot = spark.range(6000).selectExpr("0L AS job_id", "0L AS stage_id", "id AS task_id")
    rest = spark.range(12000).selectExpr("1 + id % 199 AS job_id", "id % 3 AS stage_id", "id AS task_id")
    tasks = hot.unionByName(rest).selectExpr(
        "'r' AS run", "job_id", "stage_id", "0L AS attempt", "task_id", "'e' AS executor_id", "1L AS launch", "2L AS finish",
        *[f"1L AS {c}" for c in ("duration", "getting_result", "run_ms", "cpu_ns", "deser_cpu_ns", "deser_ms", "gc_ms", "ser_ms")])
    stages = tasks.groupBy("run", "job_id", "stage_id", "attempt").agg(F.count("*").cast("int").alias("num_tasks"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.enabled",
                                          "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        series = M.task_series(jobs, stages, tasks, most=500).withColumn("p", F.spark_partition_id())
        by = {r.p: r.n for r in series.where("job_id = 0").groupBy("p").agg(F.count("*").alias("n")).collect()}
        assert sum(by.values()) == 6000 * 8 and len(by) >= 6 and max(by.values()) < 0.4 * sum(by.values())
        key = ["run", "job_id", "stage_id"]
        parts = key_parts(stages.select(*key, F.col("num_tasks").alias("n")), "n", 500)
        joined = join_in_parts(tasks, jobs.select("run", "job_id").distinct().withColumn("stage_id", F.lit(0).cast("long")),
                               key, parts, ["task_id"], "left").withColumn("p", F.spark_partition_id())
        assert joined.count() == tasks.count()
        assert joined.where("job_id = 0").select("p").distinct().count() >= 6
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_derived_logs_are_compressed_and_written_once(spark, tmp_path):
    """every line of the derived logs lies in a compressed file, in the folder of its log."""
    import gzip

    from quarkframe.sources.log_tables import event_logs

    path = event_logs(spark, SMALL)
    files = [f for f in pathlib.Path(path).rglob("part-*") if "done" not in f.parts]
    assert files and all(f.name.endswith(".txt.gz") for f in files)
    lines = [(f.parent.name, json.loads(x)) for f in files for x in gzip.open(f, "rt", encoding="utf-8")]
    orders, items = (spark.read.parquet(f"{SMALL}/{t}.parquet").count() for t in ("orders", "lineitem"))
    kinds = Counter(e["Event"] for _, e in lines)
    assert kinds["SparkListenerJobStart"] == kinds["SparkListenerJobEnd"] == orders
    assert kinds["SparkListenerTaskEnd"] == items
    assert {f for f, _ in lines} == {f"application=eventlog_v2_{e}_{t}__tables" for e in (14, 7) for t in (70, 35)}


def test_rows_learn_their_parts_without_an_exchange(spark):
    """F8: with broadcast by size off, rows are dealt to parts where they are."""
    from quarkframe.operators.skew import deal_parts

    rows = spark.range(100).selectExpr("id % 3 AS k", "id")
    parts = spark.createDataFrame([(1, 4)], "k long, _parts int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = deal_parts(rows, ["k"], parts, ["id"])
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan
        got = {(r.k, r._part) for r in dealt.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {(0, 0), (2, 0), (1, 0), (1, 1), (1, 2), (1, 3)}


def test_nested_metrics_cross_one_exchange_and_are_compressed(spark, tmp_path):
    """jobs, stages and tasks become nested records by one exchange of their rows."""
    from quarkframe.sources.metrics_json import nested_jobs, write_nested_metrics

    tables = _metric_rows(spark)
    plan = nested_jobs(tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1
    # the other exchanges count stages and tasks: their rows carry no field of a task
    assert not [x for x in plan.splitlines() if "SortMergeJoin" in x]
    path = write_nested_metrics(tables, str(tmp_path / "m"))
    files = list(pathlib.Path(path).rglob("part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)


def test_rows_of_a_job_label_name_its_run(spark):
    from quarkframe.sources.metrics_json import nested_jobs

    tables = _metric_rows(spark)
    rows = nested_jobs(tables | {"jobs": tables["jobs"].withColumn("label", F.concat("run", F.lit("+")))}).collect()
    assert {r.run for r in rows} == {"14_70__a+", "7_35__b+"} and len(rows) == 5


def test_repeated_jobs_are_one_in_each_of_their_runs(spark):
    from quarkframe.sources.metrics_json import nested_jobs

    tables = _metric_rows(spark)
    jobs = tables["jobs"].withColumn("label", F.lit("14_70__x"))
    jobs = jobs.unionByName(jobs).unionByName(jobs.withColumn("label", F.lit("7_70__y")))
    rows = nested_jobs(tables | {"jobs": jobs, "stages": tables["stages"].unionByName(tables["stages"])}).collect()
    once = {(r.id, len(r.stages), sum(len(s.tasks) for s in r.stages.values())) for r in nested_jobs(tables).collect()}
    for run in ("14_70__x", "7_70__y"):
        got = [(r.id, len(r.stages), sum(len(s.tasks) for s in r.stages.values())) for r in rows if r.run == run]
        assert len(got) == 5 and set(got) == once


def test_nested_metrics_are_grouped_in_the_order_of_one_sort(spark):
    """as they are written, records are put together without hashing, and rows are
    sorted once; settings are as before afterwards."""
    from quarkframe.session import settings
    from quarkframe.sources.metrics_json import _WRITE_SETTINGS, nested_jobs

    tables, before = _metric_rows(spark), [spark.conf.get(k, None) for k in _WRITE_SETTINGS]
    with settings(spark, _WRITE_SETTINGS):
        plan = nested_jobs(tables)._jdf.queryExecution().executedPlan().toString()
    assert [spark.conf.get(k, None) for k in _WRITE_SETTINGS] == before
    above = plan.split("REPARTITION_BY_COL")[0]
    assert "HashAggregate" not in above and above.count("Sort [") == 1 and above.count("SortAggregate") == 2


def test_large_keys_are_counted_by_hash_first(spark):
    """the keys of many rows and their parts, whatever shares their hash."""
    from quarkframe.sources.metrics_json import _counted

    rows = spark.range(400).selectExpr("CASE WHEN id < 100 THEN 1 WHEN id < 121 THEN 2 WHEN id < 141 THEN 3 ELSE id END AS k", "1 AS x")
    for buckets in (1, 7, 1 << 18):
        got = _counted(rows, ["k"], 20, buckets)
        assert {(r.k, r._parts) for r in got.collect()} == {(1, 5), (2, 2)}
    exact = _counted(rows, ["k"], 20)._jdf.queryExecution().executedPlan().toString()
    assert exact.count("hashpartitioning(_b") == 1


def test_nested_metrics_of_many_runs_and_pieces_are_written_at_once(spark, tmp_path):
    """more runs in a task than files that are open at once."""
    from quarkframe.sources.metrics_json import read_nested_metrics, write_nested_metrics

    tables = _metric_rows(spark)
    jobs = spark.range(80).selectExpr("'x' AS run", "id AS job_id", "concat(id, '_1__t') AS label", "'g' AS group_id", "'d' AS desc",
                                      "id AS start", "id AS end").coalesce(1)
    none = {t: tables[t].where("false") for t in ("stages", "tasks")}
    got = read_nested_metrics(spark, write_nested_metrics(none | {"jobs": jobs}, str(tmp_path / "m")))
    assert {(r.run, r.job_id, r.n_exec) for r in got["jobs"].collect()} == {(f"{i}_1__t", i, i) for i in range(80)}


def test_lines_of_several_records_with_and_without_brackets(spark, tmp_path):
    from quarkframe.sources.metrics_json import read_nested_metrics

    stage = '"stages": {"4.1": {"id": 4, "name": "s}", "numTasks": 2, "tasks": {"0": {"id": 0, "duration": 7}}}}'
    (tmp_path / "7_70__a.json").write_text(f'{{"id": 1, {stage}}},{{"id": 2, {stage}}}\n[{{"id": 3, {stage}}},\n {{"id": 4}} ]\n{{"groupId": "none"}}\n')
    t = read_nested_metrics(spark, str(tmp_path))
    assert sorted(r.job_id for r in t["jobs"].collect()) == [1, 2, 3, 4]
    assert sorted((r.job_id, r.stage_id, r.attempt, r.name, r.num_tasks, r.submission) for r in t["stages"].collect()) == [
        (j, 4, 1, "s}", 2, -1) for j in (1, 2, 3)]
    assert sorted((r.job_id, r.attempt, r.duration) for r in t["tasks"].collect()) == [(j, 1, 7) for j in (1, 2, 3)]
