"""Fixed-width histogram binning as a Column expression.

Bin numbering (stored in the ``bin`` column of histogram tables):

* ``0 .. n-1``  regular bins, ``bin = floor(n * (x - lo) / (hi - lo))``
* ``-1``        underflow (``x < lo``)
* ``n``         overflow (``x >= hi``)
* ``n + 2``     NaN ("nanflow")
* NULL input    not filled (the row is dropped from the histogram)

NaN is tested first because Spark orders NaN above every number.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

UNDERFLOW = -1


def overflow_bin(n: int) -> int:
    return n


def nan_bin(n: int) -> int:
    return n + 2


def _d(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def bin_index_sql(x: str, n: int, lo: float, hi: float) -> str:
    """SQL text of the bin index of expression ``x``."""
    x = f"CAST({x} AS DOUBLE)"
    return (f"(CASE WHEN {x} IS NULL THEN CAST(NULL AS INT) WHEN isnan({x}) THEN {nan_bin(n)} "
            f"WHEN {x} < {_d(lo)} THEN {UNDERFLOW} WHEN {x} >= {_d(hi)} THEN {overflow_bin(n)} "
            f"ELSE CAST(floor({_d(n)} * ({x} - {_d(lo)}) / {_d(float(hi) - float(lo))}) AS INT) END)")


def bin_index(x, n: int, lo: float, hi: float) -> Column:
    """Bin index of ``x`` (SQL text / column name, or a Column)."""
    if isinstance(x, str):
        return F.expr(bin_index_sql(x, n, lo, hi))
    x = x.cast("double")
    return (
        F.when(x.isNull(), F.lit(None).cast("int"))
        .when(F.isnan(x), F.lit(nan_bin(n)))
        .when(x < F.lit(float(lo)), F.lit(UNDERFLOW))
        .when(x >= F.lit(float(hi)), F.lit(overflow_bin(n)))
        .otherwise(F.floor(F.lit(float(n)) * (x - F.lit(float(lo))) / F.lit(float(hi) - float(lo))).cast("int"))
    )


ValueFn = Union[str, Column]


@dataclass(frozen=True)
class Bin:
    """One 1-D fixed-width histogram: ``n`` bins over ``[lo, hi)`` of ``value``.

    ``value`` is a SQL expression (usually a column name) or a Column.
    """

    label: str
    n: int
    lo: float
    hi: float
    value: ValueFn

    def sql(self, element: str | None = None) -> str:
        """SQL text of the bin index; ``element`` prefixes a struct column."""
        assert isinstance(self.value, str)
        v = f"{element}.{self.value}" if element else self.value
        return bin_index_sql(v, self.n, self.lo, self.hi)

    def expr(self, element: str | None = None) -> Column:
        if isinstance(self.value, str):
            return F.expr(self.sql(element))
        return bin_index(self.value, self.n, self.lo, self.hi)
