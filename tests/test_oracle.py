"""Every registered query against its DuckDB oracle (the driver's gate),
once with the default store and once with tiny fragments so that every
event of more than 3 particles takes the hot (split-event) path."""

import math
from collections import Counter

import pytest

import __spark_entry__ as E
from quarkframe.plans import catalog
from quarkframe.sources import events as ev_src

from conftest import SF_SMALL


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def _key(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def _check(spark, duck, name, sf):
    df = E.queries()[name](spark, sf)
    rows, cols = df.collect(), df.columns
    rel = duck(sf).sql(E.oracle_sql()[name])
    assert sorted(cols) == sorted(rel.columns)
    orows = rel.fetchall()
    assert len(rows) == len(orows)
    assert _key(cols, rows) == _key(rel.columns, orows)


NAMES = sorted(E.oracle_sql())


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
    assert set(catalog.QUERIES) <= set(E.queries()) and set(catalog.ORACLE_SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    _check(spark, duck, name, SF_SMALL)


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith("k_")])
def test_query_matches_oracle_split_events(spark, duck, name, monkeypatch):
    monkeypatch.setattr(ev_src, "CHUNK", 3)
    _check(spark, duck, name, SF_SMALL)


def test_split_store_really_splits(spark, monkeypatch):
    from pyspark.sql import functions as F

    ev = ev_src.events(spark, SF_SMALL, chunk=3)
    hot = ev.where(F.col("n_frag") > 1)
    assert hot.count() > 0
    # fragment sizes are bounded and sum to the event size
    per_ev = hot.groupBy("evt", "n_muons").agg(F.sum(F.size("muons")).alias("s"))
    assert per_ev.where(F.col("s") != F.col("n_muons")).count() == 0


def test_unsplit_store_has_one_fragment_per_event(spark):
    ev = ev_src.events(spark, SF_SMALL)
    assert ev.where("n_frag <> 1 OR frag <> 0").count() == 0
    assert ev.count() == ev.select("evt").distinct().count()
    assert ev.columns == ev_src.events(spark, SF_SMALL, chunk=3).columns


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["label", "bin", "lo", "hi", "n"]
    assert df.count() > 0
