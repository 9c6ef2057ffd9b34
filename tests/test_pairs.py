"""Pairing invariants and top-k on hand-made events (fast path and split path)."""

import pytest
from pyspark.sql import functions as F

from quarkframe.functions import kinematics as K
from quarkframe.operators import pairs as P

CAND = "array<struct<qx3:int,pt:float,eta:float,phi:float>>"
ROWS = [
    (1, [(1, 5.0, 0.1, 0.2)]),
    (2, [(1, 7.0, 0.1, 0.2), (-1, 7.0, 0.3, 0.4), (1, 3.0, -0.5, 1.0)]),
    (3, [(1, 9.0, 1.1, -0.2), (-1, 2.0, 0.3, 2.4)]),
    (4, []),
]


@pytest.fixture(scope="module")
def ev(spark):
    return spark.createDataFrame(ROWS, f"evt bigint, muons {CAND}")


def _as_store(spark, rows, split_evt=None):
    """Event-store layout; ``split_evt`` is spread over one fragment per muon."""
    out = []
    for evt, m in rows:
        if evt == split_evt:
            out += [(evt, i, len(m), len(m), [x]) for i, x in enumerate(m)]
        else:
            out.append((evt, 0, 1, len(m), m))
    return spark.createDataFrame(out, f"evt bigint, frag int, n_frag int, n_muons int, muons {CAND}")


def test_ordered_pairs_count_is_sum_n_squared(ev):
    assert P.ordered_pairs(ev, "muons").count() == sum(len(m) ** 2 for _, m in ROWS)
    assert P.ordered_pairs(ev, "muons", unordered=True).count() == sum(
        len(m) * (len(m) - 1) // 2 for _, m in ROWS)


def test_mass2_symmetric(ev):
    p = P.ordered_pairs(ev, "muons").select("evt", "fa", "i", "fb", "j", K.pair_mass2("pair").alias("m"))
    d = {(r.evt, r.i, r.j): r.m for r in p.collect()}
    for (e, i, j), m in d.items():
        assert d[(e, j, i)] == m


def test_split_event_pairs_equal_fast_path(spark):
    def mass_multiset(df):
        p = P.ordered_pairs(df, "muons").select("evt", F.round(K.pair_mass2("pair"), 9).alias("m"))
        return sorted((r.evt, r.m) for r in p.collect())

    assert mass_multiset(_as_store(spark, ROWS)) == mass_multiset(_as_store(spark, ROWS, split_evt=2))


def test_top_k_split_equals_fast(spark):
    fast = P.event_top_k(_as_store(spark, ROWS), {"muons": 2}).collect()
    split = P.event_top_k(_as_store(spark, ROWS, split_evt=2), {"muons": 2}).collect()
    assert sorted(map(str, fast)) == sorted(map(str, split))
    got = {r.evt: [m.pt for m in r.muons] for r in fast}
    assert got == {1: [5.0], 2: [7.0, 7.0], 3: [9.0, 2.0], 4: []}


def test_top2_pair_only_events_with_two(ev):
    t = P.top2_pair(ev, "muons").collect()
    assert sorted(r.evt for r in t) == [2, 3]


def test_window_group_limit_in_split_top_k(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = P.event_top_k(_as_store(spark, ROWS, split_evt=2), {"muons": 2})._jdf \
            .queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # partial top-k before the shuffle: at most k rows per event and map task move
    assert "WindowGroupLimit" in plan


def test_symmetric_weighted_pairs_equal_ordered(spark):
    from quarkframe.functions.histogram import Bin
    from quarkframe.operators.histogram import fill_bundle

    bins = [Bin("m", 50, 0.0, 500.0, "mass2"), Bin("pt", 20, 0.0, 40.0, "pt")]
    for split in (None, 2):
        st = _as_store(spark, ROWS, split_evt=split)
        full = fill_bundle(P.ordered_pairs(st).select(*P.pair_columns("pair")), bins)
        half = fill_bundle(P.symmetric_pairs(st).select("w", *P.pair_columns("pair")), bins, weight="w")
        assert sorted(map(tuple, full.collect())) == sorted(map(tuple, half.collect()))
        assert P.symmetric_pairs(st).agg(F.sum("w")).first()[0] == sum(len(m) ** 2 for _, m in ROWS)
