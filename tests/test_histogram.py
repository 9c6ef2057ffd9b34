"""Binning edges, flows, bundles and densify."""

import math

from pyspark.sql import functions as F

from quarkframe.functions.histogram import Bin, bin_index, nan_bin
from quarkframe.operators.histogram import densify, fill, fill_bundle


def test_bin_edges(spark):
    vals = [0.0, 199.999, 200.0, -0.001, math.nan, None, 1.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.b for r in df.select(bin_index("x", 200, 0.0, 200.0).alias("b")).collect()]
    assert got == [0, 199, 200, -1, nan_bin(200), None, 1]


def test_fill_counts_and_invariant(spark):
    df = spark.range(1000).select((F.col("id") / 10.0).alias("x"))
    h = fill(df, Bin("x", 10, 0.0, 50.0, "x"))
    rows = {r.bin: r for r in h.collect()}
    assert sum(r.n for r in rows.values()) == 1000     # every filled row is counted once
    assert rows[0].n == 50 and rows[0].lo == 0.0 and rows[0].hi == 5.0
    assert rows[10].n == 500 and rows[10].lo == 50.0 and rows[10].hi is None


def test_bundle_is_union_of_single_histograms(spark):
    df = spark.range(500).select((F.col("id") % 37).cast("double").alias("a"),
                                 (F.col("id") % 11 - 5).cast("double").alias("b"))
    ba, bb = Bin("a", 10, 0.0, 30.0, "a"), Bin("b", 4, -2.0, 2.0, "b")
    both = sorted(tuple(r) for r in fill_bundle(df, [ba, bb]).collect())
    single = sorted(tuple(r) for r in fill(df, ba).union(fill(df, bb)).collect())
    assert both == single


def test_bundle_with_element_struct(spark):
    df = spark.createDataFrame([([(1.0, 2.0), (3.0, 4.0)],)], "m array<struct<p:double,q:double>>")
    x = df.select(F.explode("m").alias("x"))
    h = fill_bundle(x, [Bin("p", 4, 0.0, 4.0, "p")], element="x")
    assert sorted((r.bin, r.n) for r in h.collect()) == [(1, 1), (3, 1)]


def test_densify(spark):
    df = spark.createDataFrame([(0.5,), (2.5,), (9.0,)], "x double")
    b = Bin("x", 4, 0.0, 4.0, "x")
    d = densify(fill(df, b), [b]).collect()
    regular = sorted((r.bin, r.n) for r in d if 0 <= r.bin < 4)
    assert regular == [(0, 1), (1, 0), (2, 1), (3, 0)]
    assert [(r.bin, r.n) for r in d if r.bin == 4] == [(4, 1)]


def test_merge_adds_counts_and_refuses_other_definitions(spark):
    import pytest

    from quarkframe.functions.histogram import Bin
    from quarkframe.operators.histogram import densify, fill_bundle, merge_histograms

    bins = [Bin("a", 4, 0.0, 4.0, "x"), Bin("b", 3, -1.0, 2.0, "x")]
    rows = [0.5, 1.5, 1.6, 9.0, -3.0, float("nan"), None, 3.9]
    df = lambda v: spark.createDataFrame([(x,) for x in v], "x double")
    whole = densify(fill_bundle(df(rows), bins), bins)
    parts = [fill_bundle(df(rows[i::3]), bins) for i in range(3)]
    got = densify(merge_histograms(bins, *parts), bins)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))
    for other in ([Bin("a", 8, 0.0, 4.0, "x")], [Bin("a", 4, 0.0, 5.0, "x")], [Bin("c", 4, 0.0, 4.0, "x")]):
        with pytest.raises(Exception, match="histogram definitions differ"):
            merge_histograms(bins, parts[0], fill_bundle(df(rows), other)).collect()
