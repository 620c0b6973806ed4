"""Prescriptive layer: TOPSIS ranking (O1) of any alternatives table.

The column statistics TOPSIS needs (vector norm, max, min per criterion)
are one global aggregate used as a scalar subquery: Catalyst runs it once
and feeds the values to every row, with no cross join and no driver round
trip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import quantize

# The reference's criteria weights.
DEFAULT_CRITERIA = [("liquidity", 0.3), ("profitability", 0.25), ("feasibility", 0.2),
                    ("risk_reduction", 0.25)]


def topsis(alts: DataFrame, criteria=DEFAULT_CRITERIA, score_col: str = "topsis_score") -> DataFrame:
    """Vector-normalise each (benefit) criterion, weight it, measure the
    distance to the ideal (column max) and anti-ideal (column min);
    score = d- / (d+ + d-), NULL when both distances are 0.  The score is
    rounded to 1e-10: the norms are distributed sums whose last bits depend
    on summation order."""
    stats = alts.select(F.struct(*[e for c, _ in criteria for e in (
        F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"n_{c}"),
        F.max(c).alias(f"hi_{c}"), F.min(c).alias(f"lo_{c}"))]).alias("s")).scalar()
    dpos, dneg = F.lit(0.0), F.lit(0.0)
    out = alts
    for c, wgt in criteria:
        norm = stats[f"n_{c}"]
        v = F.try_divide(F.col(c), norm) * F.lit(wgt)
        ideal = F.try_divide(stats[f"hi_{c}"], norm) * F.lit(wgt)
        anti = F.try_divide(stats[f"lo_{c}"], norm) * F.lit(wgt)
        dpos = dpos + (v - ideal) * (v - ideal)
        dneg = dneg + (v - anti) * (v - anti)
    dp, dn = F.sqrt(dpos), F.sqrt(dneg)
    return out.withColumn(score_col, quantize(F.when((dp + dn) != 0, dn / (dp + dn)), 10))
