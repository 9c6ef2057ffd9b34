"""Order-free sums and moments: exact against fractions, equal bits for any
partitioning, mergeable, NaN and infinities as doubles have them."""

import math
import random
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quarkframe.operators import aggregate as A
from quarkframe.operators import exact

NAN, INF = float("nan"), float("inf")


def _frame(spark, values, parts=1):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)


def _total(spark, values, parts=1):
    return exact.totals(exact.accumulate(_frame(spark, values, parts), ["x"]), ["x"]).first()["x"]["sum"]


def _mixed():
    r = random.Random(1)
    return [r.gauss(0, 1) * 10.0 ** r.randint(-300, 290) for _ in range(400)] + [None, 0.0, -0.0, 5e-324]


@pytest.mark.parametrize("values", [
    [0.1] * 10, [1e20, 1.0, -1e20], [1e300, -1e300, 1e-300], [5e-324] * 3, [1.7976931348623157e308], [-0.25, 0.25],
    [65536.0, 65535.99999999999, -1 / 3, 2.0 ** -16], [-1e-10, -1e16], _mixed()], ids=str)
def test_sum_is_exact_and_independent_of_partitions(spark, values):
    want = float(sum(Fraction(v) for v in values if v is not None))
    assert {_total(spark, values, p) for p in (1, 7)} == {want}


def test_special_values_and_empty_input(spark):
    assert math.isnan(_total(spark, [1.0, NAN])) and math.isnan(_total(spark, [INF, -INF]))
    assert _total(spark, [INF, 1.0, None]) == INF and _total(spark, [-INF]) == -INF
    assert _total(spark, []) is None and _total(spark, [None]) is None and _total(spark, [0.0]) == 0.0
    row = A.sums(_frame(spark, [1.0, NAN]), ["x"]).first()
    assert math.isnan(row.sum_x) and A.sums(_frame(spark, []), ["x"]).first().sum_x is None
    assert A.sums(_frame(spark, [1e20, 1e20]), ["x"]).first().sum_x == 2e20


def test_moments_have_equal_bits_over_partitions_and_merge(spark):
    r = random.Random(2)
    values = [r.gauss(1e6, 3.0) for _ in range(3000)] + [r.gauss(-5, 1e-3) for _ in range(500)]
    got = {tuple(A.describe(_frame(spark, values, p), "x", 12).first()) for p in (1, 7, 64)}
    parts = [values[:10], values[10:2000], values[2000:]]
    got.add(tuple(A.describe_state(exact.merge(*[A.moments(_frame(spark, v), "x") for v in parts]), 12).first()))
    assert len(got) == 1
    n, mean, sd, low, high = got.pop()
    assert (n, low, high) == (len(values), round(min(values), 12), round(max(values), 12))
    assert math.isclose(mean, statistics.fmean(values), rel_tol=1e-15)
    assert math.isclose(sd, statistics.stdev(map(Fraction, values)), rel_tol=1e-13)


def test_spread_far_below_the_mean_keeps_its_digits(spark):
    r = random.Random(3)
    values = [1e9 + r.random() for _ in range(500)]
    assert math.isclose(A.describe(_frame(spark, values, 3), "x", 15).first().stddev,
                        statistics.stdev(map(Fraction, values)), rel_tol=1e-9)


def test_describe_edges(spark):
    assert tuple(A.describe(_frame(spark, []), "x").first()) == (0, None, None, None, None)
    assert tuple(A.describe(_frame(spark, [3.0, None]), "x").first()) == (1, 3.0, None, 3.0, 3.0)
    assert math.isnan(A.describe(_frame(spark, [1.0, NAN]), "x").first().stddev)


def test_state_is_a_few_rows(spark):
    state = exact.accumulate(spark.range(100_000).select((F.col("id") / 7).alias("x")), ["x"])
    assert state.columns == exact.STATE and state.count() <= 4
