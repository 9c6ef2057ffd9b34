"""Fast decimal rounding of doubles for row outputs.

``F.round`` on a double goes through ``BigDecimal`` per value, which
dominated the row-producing queries (millions of values). Here rounding is
``floor(x * 10^d + 0.5) / 10^d`` in plain IEEE arithmetic -- halves round
toward +infinity. Values of ``EXACT / 10^d`` or more in magnitude pass through
unchanged, as do non-finite ones: beyond that a double has no more decimals
to round away (and Spark's ``floor`` is a BIGINT, which would clamp).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


EXACT = 9e15    # doubles of this size have no fractional part worth keeping


def round_sql(x: str, digits: int) -> str:
    s = f"CAST('{float(10 ** digits)!r}' AS DOUBLE)"
    v = f"CAST({x} AS DOUBLE)"
    most = f"CAST('{EXACT / 10 ** digits!r}' AS DOUBLE)"
    return (f"(CASE WHEN abs({v}) < {most} "
            f"THEN CAST(floor({v} * {s} + CAST('0.5' AS DOUBLE)) AS DOUBLE) / {s} ELSE {v} END)")


def round_to(x: str, digits: int) -> Column:
    """Round the SQL expression ``x`` (e.g. a column name) to ``digits`` places."""
    return F.expr(round_sql(x, digits))
