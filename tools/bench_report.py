"""Per-query stage/task totals of a bench run, from its Spark event log.

    BENCH_EVENT_LOG=1 python bench.py          # prints the log folder on stderr
    python tools/bench_report.py <log folder>

Uses the library's own event-log tables (jobs/stages/tasks keyed by the job
group that bench.py sets to the query name) and its per-job totals.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from quarkframe.operators import metrics as M  # noqa: E402
from quarkframe.session import local_session  # noqa: E402
from quarkframe.sources.eventlog import metrics_tables, read_event_log  # noqa: E402


def main() -> None:
    spark = local_session(cpus=4, shuffle_partitions=4, app="bench-report")
    t = metrics_tables(read_event_log(spark, sys.argv[1]))
    jobs = t["jobs"].where(F.col("group_id") != "")
    totals = M.job_totals(t["tasks"])
    stages = t["stages"].groupBy("run", "job_id").agg(F.count(F.lit(1)).alias("n_stages"))
    per_query = (jobs.join(totals, M.KEY).join(stages, M.KEY, "left")
                 .groupBy("group_id")
                 .agg(F.count(F.lit(1)).alias("jobs"),
                      F.sum("n_stages").alias("stages"),
                      F.round(F.sum((F.col("end") - F.col("start")) / 1000.0), 3).alias("job_wall_s"),
                      F.round(F.sum("run_s"), 3).alias("task_run_s"),
                      F.round(F.sum("cpu_s"), 3).alias("task_cpu_s"),
                      F.round(F.sum("gc_s"), 3).alias("gc_s"))
                 .orderBy(F.desc("job_wall_s")))
    per_query.show(100, truncate=False)


if __name__ == "__main__":
    main()
