"""Metrics files with nested job -> stage -> task maps.

A job maps stage ids to stages, a stage maps task ids to tasks. Files hold a
JSON array of jobs on one line, the same array with its jobs on lines of their
own (so that no line and no task holds a whole run), or one job per line, which
is what ``write_nested_metrics`` writes. Reading gives the same three tables
that event logs give. One run per file or folder, labelled by its name
(``<execs>_<threads>``); files with another suffix are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import deal_parts, key_parts
from ..session import settings
from .eventlog import run_label

PIECE_TASKS = 10_000     # tasks of a stage, or stages of a job, per written record
COUNT_BUCKETS = 1 << 18  # keys are counted by so many hash values first
# How the records are put together and written: groups of rows that come in the order of their
# keys are formed in that order (not hashed, spilled and sorted again), and each run's file is
# open at once (rows are not sorted by run first, unless a task has more runs than this).
_WRITE_SETTINGS = {"spark.sql.execution.replaceHashWithSortAgg": "true", "spark.sql.maxConcurrentOutputFileWriters": "32"}


def _fields(ddl: str) -> str:
    """Column DDL as struct field DDL (name: type)."""
    return re.sub(r"(^|, )([A-Za-z`]+) ", r"\1\2: ", ddl)


# Field names and types of the nested records.
TASK_METRICS = ("diskBytesSpilled bigint, exeDeserializeTime bigint, exeDeserializeCpuTime bigint, exeRunTime bigint, "
                "exeCpuTime bigint, bytesRead bigint, recordsRead bigint, jvmGCTime bigint, memoryBytesSpilled bigint, "
                "bytesWritten bigint, recordsWritten bigint, resultSerializationTime bigint, resultSize bigint")
TASK = ("id bigint, host string, executorId string, duration bigint, taskType string, launchTime bigint, "
        f"finishTime bigint, gettingResultTime bigint, metrics struct<{_fields(TASK_METRICS)}>")
_STAGE_OWN = "id bigint, name string, numTasks int, submissionTime bigint, completionTime bigint"
_STAGE_NAMES = re.findall(r"(\w+) \w+", _STAGE_OWN)
STAGE = f"{_STAGE_OWN}, tasks map<string, struct<{_fields(TASK)}>>"
_TOP = "id: bigint, groupId: string, `desc`: string, startTime: bigint, endTime: bigint"
# what is read of a record for the jobs and stages, and for the tasks
_HEADS = f"{_TOP}, stages: map<string, struct<{_fields(_STAGE_OWN)}>>"
_TASKS = f"id: bigint, stages: map<string, struct<id: bigint, tasks: map<string, struct<{_fields(TASK)}>>>>"


_TASK_COLUMNS = {
    "diskBytesSpilled": "disk_spill", "exeDeserializeTime": "deser_ms", "exeDeserializeCpuTime": "deser_cpu_ns",
    "exeRunTime": "run_ms", "exeCpuTime": "cpu_ns", "bytesRead": "bytes_read", "recordsRead": "records_read",
    "jvmGCTime": "gc_ms", "memoryBytesSpilled": "mem_spill", "bytesWritten": "bytes_written",
    "recordsWritten": "records_written", "resultSerializationTime": "ser_ms", "resultSize": "result_size"}
_TASK_FIELDS = {
    "task_id": "id", "host": "host", "executor_id": "executorId", "duration": "duration", "task_type": "taskType",
    "launch": "launchTime", "finish": "finishTime", "getting_result": "gettingResultTime"}
_KEY = ["run", "job_id"]


def _counted(rows: DataFrame, keys: list[str], most: int, buckets: int = COUNT_BUCKETS) -> DataFrame:
    """Keys of more than ``most`` rows and their parts. Rows are counted by a hash of
    their key first, which sends a few numbers a task; by key only those whose hash
    has more than ``most`` rows, all others cannot."""
    hashed = rows.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_b"))
    full = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("_b")
    some = hashed.join(F.broadcast(full), "_b", "left_semi")
    return key_parts(some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "n", most)


def nested_jobs(tables: dict[str, DataFrame], most: int = PIECE_TASKS) -> DataFrame:
    """The tables as nested records, one row per job (run, id, groupId,
    desc, startTime, endTime, stages: map of stages with maps of tasks).

    A stage of more than ``most`` tasks, and a job of more than ``most`` stages,
    comes in several pieces (rows that repeat the job with other stages or
    tasks), so that no map grows without bound. Map keys are ids; a retried
    stage's key is ``id.attempt``, a further piece's ``id.attempt.piece``, a
    repeated task id's ``id.position``. Tasks of a stage without a record are
    left out, as a listener that records completed stages leaves them out. The
    column ``label`` of the jobs, if there, is written as their run. Rows of one
    job in one run, and of one attempt of a stage, are one (the greatest)."""
    key, jobs = [*_KEY, "stage_id", "attempt"], tables["jobs"]
    to_parts = lambda rows, keys, parts, name: (  # noqa: E731 - a row for each part of its key
        rows.join(F.broadcast(parts), keys, "left")
        .withColumn(name, F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts"))
    cut = _counted(tables["tasks"], key, most)
    stages = to_parts(tables["stages"], key, cut, "piece")
    job_parts = _counted(stages, _KEY, most)
    tasks = deal_parts(tables["tasks"], key, cut, ["task_id", "launch"]).withColumnRenamed("_part", "piece")
    in_job = lambda rows: deal_parts(rows, _KEY, job_parts, ["stage_id", "attempt", "piece"])

    # jobs, stages and tasks cross one exchange, each a row of its own, and are sorted once
    place = [*_KEY, "_part", "stage_id", "attempt", "piece"]
    j = F.struct((F.col("label") if "label" in jobs.columns else F.col("run")).alias("run"),
                 F.col("group_id").alias("groupId"), "desc", F.col("start").alias("startTime"), F.col("end").alias("endTime"))
    st = F.struct(F.col("stage_id").alias("id"), "name", F.col("num_tasks").alias("numTasks"),
                  F.col("submission").alias("submissionTime"), F.col("completion").alias("completionTime"))
    every = (in_job(tasks).select(*place, F.lit(True).alias("is_task"), *_TASK_FIELDS, *_TASK_COLUMNS.values())
             .unionByName(in_job(stages).select(*place, st.alias("s")), allowMissingColumns=True)
             .unionByName(to_parts(jobs, _KEY, job_parts, "_part").select(*_KEY, "_part", j.alias("j")), allowMissingColumns=True)
             .repartition(*_KEY, "_part").sortWithinPartitions(*place))
    task = F.struct(*[F.col(c).alias(n) for c, n in _TASK_FIELDS.items()],
                    F.struct(*[F.col(c).alias(n) for n, c in _TASK_COLUMNS.items()]).alias("metrics"))
    before = lambda i: F.get(F.col("all"), i - 1)["id"]
    entries = F.transform("all", lambda t, i: F.struct(
        F.when((i > 0) & (before(i) == t["id"]), F.concat_ws(".", t["id"], i)).otherwise(t["id"].cast("string")), t))
    name = (F.when(F.col("piece") > 0, F.concat_ws(".", "stage_id", "attempt", "piece"))
            .when(F.col("attempt") > 0, F.concat_ws(".", "stage_id", "attempt"))
            .otherwise(F.col("stage_id").cast("string")))
    stage = F.struct("s.*", F.map_from_entries(entries).alias("tasks"))
    whole = (every.groupBy(*place).agg(F.max("s").alias("s"), F.collect_set("j").alias("js"),
                                       F.sort_array(F.collect_list(F.when(F.col("is_task"), task))).alias("all"))
             .sortWithinPartitions(*_KEY, "_part").groupBy(*_KEY, "_part").agg(F.flatten(F.collect_list("js")).alias("js"), F.collect_list(
                 F.when(F.col("s").isNotNull(), F.struct(name.alias("k"), stage.alias("v")))).alias("all")))
    # a job that occurs in several runs is written to each
    runs = F.array_distinct(F.transform("js", lambda x: x["run"]))
    of_run = F.transform(runs, lambda r: F.array_max(F.filter("js", lambda x: x["run"] == r)))
    return whole.select(*_KEY, F.explode(of_run).alias("j"), "all").select(
        "j.run", F.col("job_id").alias("id"), "j.groupId", "j.desc", "j.startTime", "j.endTime",
        F.map_from_entries("all").alias("stages"))


def write_nested_metrics(tables: dict[str, DataFrame], path: str, most: int = PIECE_TASKS) -> str:
    """Write the tables as compressed nested JSON, a job (or piece of one) per line, below
    a folder ``run=<label>`` for each run."""
    with settings(tables["jobs"].sparkSession, _WRITE_SETTINGS):
        nested_jobs(tables, most).write.partitionBy("run").option("compression", "gzip").json(path)
    return path


def _jobs(lines: DataFrame, record: str) -> DataFrame:
    """The fields ``record`` of the jobs of text lines: whole arrays, single records, or
    an array spread over lines with its brackets and commas at their ends."""
    body = F.when(F.col("value").startswith("{") & F.col("value").endswith("}"), F.col("value")).otherwise(
        F.regexp_replace(F.regexp_replace("value", r"\A[\s\[,]+", ""), r"[\s\],]+\z", ""))
    each = F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<struct<{record}>>")
    return lines.where(body != "").select("run", F.explode(each).alias("j")).select("run", "j.*").where(
        "id is not null")


def read_nested_metrics(spark: SparkSession, path: str, glob: str = "*.json{,.gz}") -> dict[str, DataFrame]:
    """``jobs``, ``stages`` and ``tasks`` of all metrics files below ``path``
    whose names match ``glob``; pieces of a job or stage are put together. The
    run is the folder ``run=<label>`` a file lies in, else the file's name.

    Jobs and stages come from one exchange of the records without their tasks, which
    every use of them reads: files are parsed once for both, however often they are used."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/run=([^/]+)/[^/]+\z", 1)
    lines = lines.select("value", F.when(folder != "", folder).otherwise(F.col("_metadata.file_name")).alias("run"))
    # a record is one value, read by transform: its fields are not picked before the exchange, which would part it in several
    attempt = lambda k: F.when(F.contains(k, F.lit(".")), F.coalesce(
        F.get(F.split(k, r"\."), F.lit(1)).cast("long"), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    entries = F.transform(F.map_entries("stages"), lambda e: F.struct(
        attempt(e["key"]).alias("attempt"), *[e["value"][c].alias(c) for c in _STAGE_NAMES]))
    heads = (_jobs(lines, _HEADS).select("run", "id", F.array(F.struct(
        "groupId", "desc", "startTime", "endTime", entries.alias("stages"))).alias("head"))
        .repartition("run", "id", F.xxhash64("head")))
    jobs = (heads.select("run", F.col("id").alias("job_id"), F.get(F.transform("head", lambda h: F.struct(
        *[h[c].alias(c) for c in ("groupId", "desc", "startTime", "endTime")])), F.lit(0)).alias("h"))
        .groupBy("run", "job_id").agg(*[F.max(f"h.{c}").alias(c) for c in ("groupId", "desc", "startTime", "endTime")])
        .select("run", "job_id", F.coalesce("groupId", F.lit("")).alias("group_id"),
                F.coalesce("desc", F.lit("")).alias("desc"), F.coalesce("startTime", F.lit(-1)).alias("start"),
                F.coalesce("endTime", F.lit(-1)).alias("end"), *run_label()))
    key = ["run", "job_id", "stage_id", "attempt"]
    stages = (heads.select("run", F.col("id").alias("job_id"), F.explode(F.flatten(F.transform("head", lambda h: h["stages"]))).alias("s"))
              .select("run", "job_id", F.col("s.id").alias("stage_id"), "s.attempt", "s")
              .groupBy(*key).agg(*[F.max(f"s.{c}").alias(c) for c in ("name", "numTasks", "submissionTime", "completionTime")])
              .select(*key, "name", F.col("numTasks").alias("num_tasks"),
                      F.coalesce("submissionTime", F.lit(-1)).alias("submission"),
                      F.coalesce("completionTime", F.lit(-1)).alias("completion")))
    t = (_jobs(lines, _TASKS).select("run", F.col("id").alias("job_id"), F.explode("stages").alias("k", "s"))
         .select("run", "job_id", F.col("s.id").alias("stage_id"), attempt(F.col("k")).alias("attempt"),
                 F.explode(F.map_values("s.tasks")).alias("t")))
    tasks = t.select(
        *key, F.col("t.id").alias("task_id"), "t.host", F.col("t.executorId").alias("executor_id"), "t.duration",
        F.col("t.taskType").alias("task_type"), F.col("t.launchTime").alias("launch"),
        F.col("t.finishTime").alias("finish"), F.col("t.gettingResultTime").alias("getting_result"),
        *[F.col(f"t.metrics.{n}").alias(c) for n, c in _TASK_COLUMNS.items()])
    return {"jobs": jobs, "stages": stages, "tasks": tasks}
