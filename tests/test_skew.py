"""Skew: one event holds a third of all particles.

The sf0.001 tables are rewritten so that every line with ``l_partkey % 3 = 0``
belongs to the smallest order; the registered queries then run end to end on
that derived pair of tables (with small fragments, so the hot event is split)
and must still equal the DuckDB oracle on the same tables.
"""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from quarkframe.sources import events as ev_src

from conftest import SF_SMALL

QUERIES = [
    "b2_count_pt", "b4_size_histogram", "b4_count_n_gt2", "b4_max_pair_mass2", "b4_top2_pair_products",
    "b5_muon_bundle_gt0", "b5_pair_bundle", "pair_mass2_wide", "higgs_lead_bundle", "photon_lead_bundle",
    "lead_pair_mass", "strip_events", "k_totals", "k_stage_summary", "k_stage_time_by_ordinal", "k_task_series",
    "k_cpu_efficiency", "reduction_job",
]


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("skewed")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    hot_key = orders.agg(F.min("o_orderkey")).first()[0]
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    li = li.withColumn("l_orderkey", F.when(F.col("l_partkey") % 3 == 0, F.lit(hot_key))
                       .otherwise(F.col("l_orderkey")))
    orders.coalesce(1).write.parquet(str(d / "orders.parquet"))
    li.coalesce(1).write.parquet(str(d / "lineitem.parquet"))
    return str(d)


def _key(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple("nan" if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order)
                   for r in rows)


def test_hot_event_is_split_into_bounded_fragments(spark, skewed_dir, monkeypatch):
    monkeypatch.setattr(ev_src, "CHUNK", 256)
    ev = ev_src.events(spark, skewed_dir)
    hot = ev.where(F.col("n_frag") > 1).select("evt", "n_muons", "n_frag", F.size("muons").alias("s")).collect()
    assert len({r.evt for r in hot}) == 1
    n = hot[0].n_muons
    total = spark.read.parquet(f"{skewed_dir}/lineitem.parquet").count()
    assert n > total / 4                       # the hot event really holds about a third
    assert sum(r.s for r in hot) == n          # no particle lost or duplicated
    assert max(r.s for r in hot) < 2 * 256     # fragments stay bounded


@pytest.mark.parametrize("name", QUERIES)
def test_queries_on_skewed_tables(spark, skewed_dir, name, monkeypatch):
    monkeypatch.setattr(ev_src, "CHUNK", 256)
    df = E.queries()[name](spark, skewed_dir)
    rows, cols = df.collect(), df.columns
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{skewed_dir}/{t}.parquet/*.parquet')")
    rel = con.sql(E.oracle_sql()[name])
    orows = rel.fetchall()
    assert sorted(cols) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert _key(cols, rows) == _key(rel.columns, orows)


def test_reduction_pairs_on_skewed_tables(spark, skewed_dir, monkeypatch):
    """All ordered pairs of the hot event (millions of rows): compared by
    per-event count, min and max of every column, computed on both sides."""
    monkeypatch.setattr(ev_src, "CHUNK", 256)
    name = "reduction_pairs"
    df = E.queries()[name](spark, skewed_dir)
    vals = [c for c in df.columns if c != "evt"]
    aggs = [F.count(F.lit(1)).alias("n")] + [f(c).alias(f"{p}_{c}") for c in vals
                                             for p, f in (("lo", F.min), ("hi", F.max))]
    got = df.groupBy("evt").agg(*aggs)
    rows, cols = got.collect(), got.columns
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{skewed_dir}/{t}.parquet/*.parquet')")
    sel = ", ".join(["COUNT(*) AS n"] + [f"{p}({c}) AS {q}_{c}" for c in vals
                                         for q, p in (("lo", "MIN"), ("hi", "MAX"))])
    rel = con.sql(f"SELECT evt, {sel} FROM ({E.oracle_sql()[name]}) GROUP BY evt")
    orows = rel.fetchall()
    assert max(r.n for r in rows) > 1_000_000          # the hot event's pairs are all there
    assert _key(cols, rows) == _key(rel.columns, orows)
