"""Exact money arithmetic.

Prices, discounts, taxes and event values in the source tables are exact to
two decimals and quantities are integral.  We carry them as integer cents
(BIGINT) so that sums are associative: any partition layout, and any engine
(the DuckDB oracle included), produces bit-identical totals.  Aggregation on
BIGINT also stays on the fast, code-generated path (DECIMAL above precision
18 would fall back to java BigDecimal).  Conversion to DOUBLE happens once, at
the end: ``units / 10^scale`` is a correctly rounded IEEE division as long as
the unit count is below 2^53.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(col: str | Column) -> Column:
    """DOUBLE with two exact decimals -> BIGINT hundredths."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c * F.lit(100.0)).cast("bigint")


def units(col: str | Column) -> Column:
    """Integral DOUBLE (a quantity) -> BIGINT."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c).cast("bigint")


def to_double(col: str | Column, scale: int) -> Column:
    """BIGINT units of 10^-scale -> DOUBLE."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("double") / F.lit(float(10 ** scale))


def exact_std(n: Column, sx: Column, sxx: Column, scale: int) -> Column:
    """Sample std (ddof=1) from exact count, sum and sum of squares.

    ``sx`` and ``sxx`` are BIGINT sums of values in units 10^-scale (and of
    their squares).  The variance numerator ``n*sxx - sx^2`` is evaluated in
    DECIMAL(38,0), so there is no cancellation; only the final division and
    the square root are floating point.
    """
    d = "decimal(38,0)"
    num = n.cast(d) * sxx.cast(d) - sx.cast(d) * sx.cast(d)
    den = (n.cast("double") * (n - 1).cast("double")) * F.lit(float(10 ** (2 * scale)))
    return F.when(n >= 2, F.sqrt(num.cast("double") / den))


def exact_mean(n: Column, sx: Column, scale: int) -> Column:
    return F.when(n > 0, to_double(sx, scale) / n.cast("double"))
