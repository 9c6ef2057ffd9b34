"""Fill fixed-width histograms and bundles of them in one pass.

A bundle is a list of :class:`~quarkframe.functions.histogram.Bin`. Every
input row contributes one ``(label, bin)`` item per histogram; the items go
straight into a ``groupBy(label, bin).count()``, which Spark runs as a
map-side partial aggregation, so the shuffle carries at most
``bins x map tasks`` rows no matter how many rows are filled.

Result (sparse, non-empty bins only)::

    label string, bin int, lo double, hi double, n bigint

``lo``/``hi`` are the bin edges rounded to 6 places; the flow bins carry the
range edge on their finite side and NULL on the other (NaN bin: both NULL).
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.histogram import UNDERFLOW, Bin, _d, nan_bin, overflow_bin


def bin_items(bins: Sequence[Bin], element: str | None = None) -> Column:
    """``array<struct<label, bin>>`` with one item per histogram."""
    if all(isinstance(b.value, str) for b in bins):
        return F.expr("array(" + ", ".join(
            f"named_struct('label', '{b.label}', 'bin', {b.sql(element)})" for b in bins) + ")")
    return F.array(*[
        F.struct(F.lit(b.label).alias("label"), b.expr(element).alias("bin")) for b in bins
    ])


def _edges(bins: Sequence[Bin]) -> tuple[Column, Column]:
    """Bin edges (rounded to 6 places) as two SQL CASE expressions."""
    lo_cases, hi_cases = [], []
    for b in bins:
        w = _d((float(b.hi) - float(b.lo)) / float(b.n))
        lo_cases.append(
            f"WHEN label = '{b.label}' THEN (CASE WHEN bin = {UNDERFLOW} THEN CAST(NULL AS DOUBLE) "
            f"WHEN bin = {overflow_bin(b.n)} THEN {_d(b.hi)} WHEN bin = {nan_bin(b.n)} THEN CAST(NULL AS DOUBLE) "
            f"ELSE round({_d(b.lo)} + bin * {w}, 6) END)")
        hi_cases.append(
            f"WHEN label = '{b.label}' THEN (CASE WHEN bin = {UNDERFLOW} THEN {_d(b.lo)} "
            f"WHEN bin >= {overflow_bin(b.n)} THEN CAST(NULL AS DOUBLE) "
            f"ELSE round({_d(b.lo)} + (bin + 1) * {w}, 6) END)")
    return F.expr("CASE " + " ".join(lo_cases) + " END"), F.expr("CASE " + " ".join(hi_cases) + " END")


def aggregate_items(items: DataFrame, bins: Sequence[Bin], weight: str | None = None) -> DataFrame:
    """Count ``(label, bin)`` rows (or sum their integer ``weight``) into the
    histogram table."""
    lo_e, hi_e = _edges(bins)
    n = F.count(F.lit(1)) if weight is None else F.sum(weight).cast("long")
    return (items.where(F.col("bin").isNotNull())
            .groupBy("label", "bin").agg(n.alias("n"))
            .select("label", "bin", lo_e.alias("lo"), hi_e.alias("hi"), "n"))


def fill_bundle(df: DataFrame, bins: Sequence[Bin], element: str | None = None,
                weight: str | None = None) -> DataFrame:
    """Fill every histogram of ``bins`` from the rows of ``df`` in one pass.

    ``element`` names a struct column whose fields the bins read (e.g. the
    exploded particle ``x``); without it bins read top-level columns.
    ``weight`` names an integer column: each row then counts that many times.
    """
    cols = [F.col(weight).alias("_w")] if weight else []
    items = df.select(*cols, F.inline(bin_items(bins, element)))
    return aggregate_items(items, bins, "_w" if weight else None)


def fill(df: DataFrame, b: Bin, element: str | Column | None = None) -> DataFrame:
    """A single histogram (a bundle of one)."""
    return fill_bundle(df, [b], element)


def merge_histograms(bins: Sequence[Bin], *tables: DataFrame) -> DataFrame:
    """Combine filled bundles (tables label, bin, lo, hi, n, for instance stored
    ones) of disjoint rows: counts are added. Every row's label and edges must
    be those of ``bins``; a table filled with other definitions fails the query."""
    lo_e, hi_e = _edges(bins)
    known = F.col("label").isin([b.label for b in bins])
    same = known & F.col("lo").eqNullSafe(lo_e) & F.col("hi").eqNullSafe(hi_e)
    clash = F.concat(F.lit("histogram definitions differ: "), F.coalesce("label", F.lit("null")), F.lit(" bin "),
                     F.coalesce(F.col("bin").cast("string"), F.lit("null")))
    rows = reduce(DataFrame.unionByName, [t.select("label", "bin", "lo", "hi", "n") for t in tables])
    checked = rows.select("label", "bin", F.when(F.coalesce(same, F.lit(False)), F.col("n")).otherwise(
        F.raise_error(clash).cast("bigint")).alias("n"))
    return aggregate_items(checked, bins, "n")


def densify(hist: DataFrame, bins: Sequence[Bin]) -> DataFrame:
    """Add zero rows for empty regular bins (bins x labels rows, tiny)."""
    spark = hist.sparkSession
    grid = None
    for b in bins:
        g = spark.range(b.n).select(F.lit(b.label).alias("label"), F.col("id").cast("int").alias("bin"))
        grid = g if grid is None else grid.unionByName(g)
    lo_e, hi_e = _edges(bins)
    grid = grid.select("label", "bin", lo_e.alias("lo"), hi_e.alias("hi"))
    full = grid.join(hist.select("label", "bin", "n"), ["label", "bin"], "left")
    dense = full.select("label", "bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    # keep flow rows of the sparse input (they are not part of the grid)
    in_grid = None
    for b in bins:
        c = (F.col("label") == b.label) & (F.col("bin") >= 0) & (F.col("bin") < b.n)
        in_grid = c if in_grid is None else in_grid | c
    return dense.unionByName(hist.where(~in_grid))
