"""Aggregations of the benchmark (A1-A10) as DataFrame aggregates.

Every reduction the reference runs on the driver (``reduce``, ``aggregate``)
or through a full-group shuffle (``rdd.groupBy``) becomes a built-in
aggregate with map-side partial aggregation; the driver only ever receives
the final, small result.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exact
from .nested import first_fragment, size_of


def count_rows(df: DataFrame, alias: str = "n") -> DataFrame:
    """A1/A2: row count (apply the filter first for A2)."""
    return df.agg(F.count(F.lit(1)).alias(alias))


def count_events(ev: DataFrame, alias: str = "n_events") -> DataFrame:
    """A1 on an event store: events, not fragments."""
    return count_rows(first_fragment(ev), alias)


def sums(df: DataFrame, cols: Sequence[str], digits: int = 3, prefix: str = "sum_") -> DataFrame:
    """A3/A4: sums (empty input -> NULL), rounded; equal bits for any order or
    partitioning of the rows. NaN and infinities sum as doubles do."""
    got = exact.totals(exact.accumulate(df, cols), cols)
    return got.select(*[F.round(F.col(c)["sum"], digits).alias(prefix + c) for c in cols])


def moments(df: DataFrame, col: str) -> DataFrame:
    """The mergeable state of ``describe``: exact sums of the values, of their
    squares and of the squares' rounding errors."""
    # the two halves of x multiply without rounding, which gives p's error
    v = df.selectExpr(f"CAST(`{col}` AS DOUBLE) AS x", "x * x AS p", "x * 134217729D AS t", "t - (t - x) AS h", "x - h AS l")
    return exact.accumulate(v, {"x": "x", "p": "p", "e": "((h * h - p) + 2D * h * l) + l * l"})


def describe_state(state: DataFrame, digits: int = 6) -> DataFrame:
    """count, mean, sample stddev, min, max from a state of ``moments``. The
    variance is formed from sums of twice a double's precision, so that a mean
    far above the spread costs no digits."""
    s = exact.totals(state, ["x", "p", "e"])
    # n * (sum of squares) - (sum)^2, both as pairs of doubles
    s = s.selectExpr("x.*", "CAST(x.n AS DOUBLE) AS m", "p.hi AS q", "(p.lo + e.hi) + e.lo AS ql", "x.hi AS u", "x.lo AS ul")
    halves = lambda c: f"({c} * 134217729.0D - ({c} * 134217729.0D - {c}))"
    s = s.selectExpr("*", f"{halves('m')} AS mh", f"{halves('q')} AS qh", f"{halves('u')} AS uh")
    s = s.selectExpr("*", "m * q AS mq", "u * u AS uu", "m - mh AS mt", "q - qh AS qt", "u - uh AS ut")
    s = s.selectExpr("*", "((mh * qh - mq) + mh * qt + mt * qh) + mt * qt + m * ql AS mql",
                     "((uh * uh - uu) + 2D * uh * ut) + ut * ut + 2D * u * ul AS uul")
    spread = F.greatest((F.col("mq") - F.col("uu")) + (F.col("mql") - F.col("uul")), F.lit(0.0))
    variance = F.when(F.col("special").isNotNull(), F.lit(float("nan"))).when(
        F.col("n") > 1, spread / F.col("m") / (F.col("m") - 1))
    return s.select("n", F.round(F.try_divide(F.col("sum"), F.col("m")), digits).alias("mean"),
                    F.round(F.sqrt(variance), digits).alias("stddev"), F.round("least", digits).alias("min"),
                    F.round("greatest", digits).alias("max"))


def describe(df: DataFrame, col: str, digits: int = 6) -> DataFrame:
    """A5: count, mean, sample stddev, min, max as numbers (not strings); equal
    bits for any order or partitioning of the rows."""
    return describe_state(moments(df, col), digits)


def size_histogram(ev: DataFrame, coll: str = "muons") -> DataFrame:
    """Number of events per collection size."""
    return (first_fragment(ev).groupBy(size_of(ev, coll).alias(f"n_{coll}"))
            .agg(F.count(F.lit(1)).alias("n_events")))


def sum_of_group_counts(grouped: DataFrame, col: str = "n_events") -> DataFrame:
    """Total of the per-group counts."""
    return grouped.agg(F.sum(col).cast("long").alias(col))


def argmax(df: DataFrame, record: Column, order: Sequence[Column]) -> DataFrame:
    """The record with the largest ordering key.

    Ties are broken deterministically by the remaining key columns (the
    reference's reduce keeps an arbitrary one).
    """
    return df.agg(F.max_by(record, F.struct(*order)).alias("best")).select("best.*")
