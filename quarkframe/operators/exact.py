"""Sums of doubles that do not depend on the order of the rows (A3-A5).

Adding doubles rounds at every step, so a plain sum changes with partitioning.
Here each value is cut, without rounding, into whole-number limbs: with
``b = floor(log2|x| / 16)`` the value is ``y * 2^(16 b)``, ``1 <= |y| < 2^16``, and
y is four limbs of at most 18 bits. Limbs of one bin b are added as longs, which
is exact in any order; no sum overflows below 2^45 rows. Every finite double
falls into one of 134 bins, so any mix of magnitudes stays exact; NaN and the
infinities have bins of their own and are counted there.

``accumulate`` gives the state, a few rows per column: (name, bin, limbs, count,
least, greatest). States of disjoint rows ``merge`` by adding. ``total`` carries
between bins exactly and rounds once, to within an ulp of the exact sum, so that
equal rows give equal bits however they were partitioned or merged. All of it is
column expressions: one partial aggregate, an exchange of the state, no pass
over the rows but one.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 16                        # bits between bins
LIMB = 18                         # bits of a limb
LIMBS = 4
LEAST, MOST = -68, 65             # bins of the least and the greatest double
CARRY = 8                         # bins above the greatest in use that a carry may reach
NAN, PLUS_INF, MINUS_INF = 100, 101, 102
STATE = ["name", "bin", *[f"l{i}" for i in range(LIMBS)], "n", "lo", "hi"]


def _powers(exponents: list[int]) -> str:
    """SQL text of an array of powers of two."""
    return "array(" + ", ".join(f"{2.0 ** e!r}D" for e in exponents) + ")"


# limb i is what the remainder r<i> holds above its point; the rest moves up
_LIMB_STEPS = ["CAST(r0 AS BIGINT) AS l0"] + [
    step for i in range(1, LIMBS)
    for step in (f"(r{i - 1} - l{i - 1}) * {1 << LIMB}D AS r{i}", f"CAST(r{i} AS BIGINT) AS l{i}")]
# twice half the power: neither factor nor product leaves the range of doubles
_HALF = _powers([-(WIDTH // 2) * b for b in range(LEAST, MOST + 1)])
_BIN = f"""
    CASE WHEN isnan(x) THEN {NAN} WHEN x = double('inf') THEN {PLUS_INF} WHEN x = double('-inf') THEN {MINUS_INF}
         WHEN x = 0 THEN 0 ELSE CAST(floor(log2(abs(x)) / {WIDTH}) AS INT) END AS bin"""
_SUMS = [*[f"sum(l{i}) AS l{i}" for i in range(LIMBS)], "{n} AS n", "min({lo}) AS lo", "max({hi}) AS hi"]


def accumulate(df: DataFrame, values: dict[str, str] | Sequence[str]) -> DataFrame:
    """The state of columns of ``df``, or of SQL expressions by name; nulls do not count."""
    values = values if isinstance(values, dict) else {c: f"`{c}`" for c in values}
    # columns are numbered, so that the grouping keys are two small integers
    pairs = ", ".join(f"named_struct('c', {i}, 'x', CAST({e} AS DOUBLE))" for i, e in enumerate(values.values()))
    v = df.selectExpr(f"inline(array({pairs}))").where("x IS NOT NULL").selectExpr(
        "c", "x", _BIN, f"CASE WHEN bin < {NAN} THEN get({_HALF}, bin - {LEAST}) ELSE 0D END AS h",
        f"CASE WHEN bin < {NAN} THEN x * h * h ELSE 0D END AS r0", *_LIMB_STEPS)
    state = v.groupBy("c", "bin").agg(*[F.expr(e.format(n="count(1)", lo="x", hi="x")) for e in _SUMS])
    of = "array(" + ", ".join(f"'{n}'" for n in values) + ")"
    return state.selectExpr(f"get({of}, c) AS name", *STATE[1:])


def merge(*states: DataFrame) -> DataFrame:
    """The state of all rows whose states are given."""
    rows = reduce(DataFrame.unionByName, states)
    return rows.groupBy("name", "bin").agg(*[F.expr(e.format(n="sum(n)", lo="lo", hi="hi")) for e in _SUMS])


# SQL text of the sum of the finite values of one column, from its entries ``e``
# (bin, v) of bins in use, as a pair of doubles: hi, and lo, what hi lost.
_DIGITS = f"""
    aggregate(sequence(array_min(e.bin), array_max(e.bin) + {CARRY}),
              named_struct('c', CAST(0 AS DECIMAL(38,0)), 'd', CAST(array() AS ARRAY<DOUBLE>)),
              (a, b) -> named_struct(
                  'c', CAST((a.c + coalesce(try_element_at(map_from_arrays(e.bin, e.v), b), 0)
                             - pmod(CAST(a.c + coalesce(try_element_at(map_from_arrays(e.bin, e.v), b), 0) AS DECIMAL(38,0)),
                                    CAST({1 << WIDTH} AS DECIMAL(38,0)))) / {1 << WIDTH} AS DECIMAL(38,0)),
                  'd', array_append(a.d, CAST(
                      pmod(CAST(a.c + coalesce(try_element_at(map_from_arrays(e.bin, e.v), b), 0) AS DECIMAL(38,0)),
                           CAST({1 << WIDTH} AS DECIMAL(38,0))) AS DOUBLE))))"""
# from the greatest digit down, in units of the bin above them all; two-sum
_PAIR = f"""
    aggregate(reverse(g.d), named_struct('hi', CAST(g.c AS DOUBLE), 'lo', 0D, 'w', {2.0 ** -WIDTH!r}D),
              (a, x) -> named_struct(
                  'hi', a.hi + x * a.w,
                  'lo', a.lo + ((a.hi - ((a.hi + x * a.w) - ((a.hi + x * a.w) - a.hi)))
                                + (x * a.w - ((a.hi + x * a.w) - a.hi))),
                  'w', a.w * {2.0 ** -WIDTH!r}D))"""


def totals(state: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row with a struct column for each name: n (values that are not null),
    sum (null without any), hi and lo (the exact sum of the finite values as two
    doubles), special (NaN or an infinity that decides the sum, else null),
    least, greatest."""
    units = [f"CAST(l{i} AS DECIMAL(20,0)) * CAST({1 << (LIMB * (LIMBS - 1 - i))} AS DECIMAL(17,0))" for i in range(LIMBS)]
    half = _powers([WIDTH // 2 * (b + 1) - LIMB * (LIMBS - 1) // 2 for b in range(LEAST, MOST + CARRY + 1)])
    listed = state.selectExpr("name", "bin", f"CAST({' + '.join(units)} AS DECIMAL(38,0)) AS v", "n", "lo", "hi").agg(
        F.collect_list(F.struct("name", "bin", "v", "n", "lo", "hi")).alias("all"))
    array = "array(" + ", ".join(f"'{n}'" for n in names) + ")"
    # one entry per name, each step of the sum once for all of them
    steps = (listed.selectExpr(f"transform({array}, k -> filter(all, s -> s.name = k)) AS s")
             .selectExpr("s", f"""transform(s, q -> filter(q, t -> t.bin < {NAN} AND t.v <> 0)) AS used""")
             .selectExpr("s", "used", f"transform(used, e -> CASE WHEN size(e) > 0 THEN {_DIGITS} END) AS digits")
             .selectExpr("s", "used", f"transform(digits, g -> CASE WHEN g IS NOT NULL THEN {_PAIR} END) AS pairs")
             .selectExpr("s", "pairs", f"transform(used, e -> get({half}, array_max(e.bin) + {CARRY - LEAST})) AS h")
             .selectExpr("s", "transform(pairs, (p, i) -> coalesce(p.hi * h[i] * h[i], 0D)) AS hi",
                         "transform(pairs, (p, i) -> coalesce(p.lo * h[i] * h[i], 0D)) AS lo",
                         f"""transform(s, q -> CASE
                             WHEN array_contains(q.bin, {NAN})
                               OR array_contains(q.bin, {PLUS_INF}) AND array_contains(q.bin, {MINUS_INF}) THEN double('NaN')
                             WHEN array_contains(q.bin, {PLUS_INF}) THEN double('inf')
                             WHEN array_contains(q.bin, {MINUS_INF}) THEN double('-inf') END) AS special"""))
    out = steps.selectExpr("""transform(s, (q, i) -> named_struct(
        'n', aggregate(q.n, 0L, (a, x) -> a + x),
        'sum', CASE WHEN size(q) > 0 THEN coalesce(special[i], hi[i] + lo[i]) END,
        'hi', hi[i], 'lo', lo[i], 'special', special[i],
        'least', array_min(q.lo), 'greatest', array_max(q.hi))) AS out""")
    return out.selectExpr(*[f"out[{i}] AS `{n}`" for i, n in enumerate(names)])
