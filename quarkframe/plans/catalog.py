"""Registry of every query: name -> (spark, sf_dir) -> DataFrame, and its oracle SQL."""

from __future__ import annotations

from . import benchmark, examples, metric_reports, oracle

QUERIES = {}
QUERIES.update(benchmark.QUERIES)
QUERIES.update(examples.QUERIES)
QUERIES.update(metric_reports.QUERIES)

ORACLE_SQL = {}
ORACLE_SQL.update(oracle.SQL)
