"""Entity feature matrix (F1), stress label (F2), month-over-month change
(W1-W2) and forward/backward fills (W3).

The reference computes these over one business's whole frame; here every
window is ``partitionBy(entity).orderBy(period)`` so the work spreads over
entities and a one-entity input reproduces the reference's numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import cents, to_double

SALES_FEATURES = ["net_sales", "cash_pct", "foodmandu_pct", "pokhara_pct", "credit_pct",
                  "discount_pct", "cash_sales", "foodmandu_sales", "credit_sales"]
FILLED_TOTALS = ["creditor_total", "debtor_total", "wastage_units"]

# Stress rule thresholds.
STRESS_MARGIN = 0.08
STRESS_COGS_RATIO = 0.52
STRESS_PRESSURE = 0.05
STRESS_PRESSURE_MARGIN = 0.12


def by_entity(order: str = "period") -> Window:
    return Window.partitionBy("entity").orderBy(order)


def pct_change(col: str, order: str = "period") -> Column:
    """pandas ``pct_change`` (x / previous - 1) over the previous *observed*
    row of the same entity; a zero previous value gives NULL, not inf."""
    prev = F.lag(col).over(by_entity(order))
    return F.try_divide(F.col(col), prev) - F.lit(1.0)


def party_totals(parties: DataFrame) -> DataFrame:
    """Sum of closing balances per (entity, period), one column per type."""
    return (parties.groupBy("entity", "period")
            .agg(to_double(F.sum(F.when(F.col("type") == "creditor", cents("closing"))), 2).alias("creditor_total"),
                 to_double(F.sum(F.when(F.col("type") == "debtor", cents("closing"))), 2).alias("debtor_total")))


def wastage_totals(waste: DataFrame) -> DataFrame:
    """Wastage units per (entity, period)."""
    return waste.groupBy("entity", "period").agg(F.sum("total").alias("wastage_units"))


def ffill_bfill(df: DataFrame, cols: list[str], order: str = "period") -> DataFrame:
    """Forward fill then backward fill, within each entity only."""
    w = Window.partitionBy("entity").orderBy(order)
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fwd = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    for c in cols:
        df = df.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(back),
                                         F.first(c, ignorenulls=True).over(fwd)))
    return df


def stress_label(pm: Column, cr: Column, mp: Column) -> Column:
    """margin < .08 or cogs ratio > .52 or (pressure > .05 and margin < .12).
    A NULL margin counts as healthy, NULL ratio and pressure as zero."""
    pm1 = F.coalesce(pm, F.lit(1.0))
    return ((pm1 < STRESS_MARGIN) | (F.coalesce(cr, F.lit(0.0)) > STRESS_COGS_RATIO)
            | ((F.coalesce(mp, F.lit(0.0)) > STRESS_PRESSURE) & (pm1 < STRESS_PRESSURE_MARGIN))).cast("int")


def mom_change(pl: DataFrame) -> DataFrame:
    """sales/cogs/profit MoM % and margin pressure."""
    return (pl.withColumn("sales_mom_pct", pct_change("sales_value"))
              .withColumn("cogs_mom_pct", pct_change("cogs"))
              .withColumn("profit_mom_pct", pct_change("profit"))
              .withColumn("margin_pressure", F.col("cogs_mom_pct") - F.col("sales_mom_pct")))


FM_COLUMNS = ["entity", "period", "month", "sales_value", "total_incomes", "cogs", "gross_profit",
              "gross_margin", "cogs_ratio", "operational_expenses", "staff_salary", "foodmandu_charges",
              "total_expenses", "profit", "profit_margin", "bread_income", "salary_to_sales",
              *SALES_FEATURES, *FILLED_TOTALS, "sales_mom_pct", "cogs_mom_pct", "profit_mom_pct",
              "margin_pressure", "liquidity_proxy", "platform_dependency", "credit_exposure", "stress"]


def feature_matrix(pl: DataFrame, sales: DataFrame, parties: DataFrame, waste: DataFrame) -> DataFrame:
    """P&L left-joined with sales (J1), party totals (J2) and wastage
    totals (J3) on (entity, period), then W1-W3 and F2.

    All inputs are aggregates keyed by (entity, period), so the joins are
    co-partitioned sort-merge joins on the same key and the windows that
    follow reuse that partitioning (partitioned by entity)."""
    return finish_features(pl.join(sales.select("entity", "period", *SALES_FEATURES), ["entity", "period"], "left")
                             .join(party_totals(parties), ["entity", "period"], "left")
                             .join(wastage_totals(waste), ["entity", "period"], "left"))


def pl_features(pl: DataFrame) -> DataFrame:
    """W1, W2 and F2 from the P&L alone: all that the label and the P&L tests need."""
    fm = mom_change(pl)
    return fm.withColumn("stress", stress_label(F.col("profit_margin"), F.col("cogs_ratio"), F.col("margin_pressure")))


def finish_features(joined: DataFrame) -> DataFrame:
    """W1-W3, derived ratios and F2 on the joined (entity, period) table."""
    fm = mom_change(joined)
    fm = (fm.withColumn("liquidity_proxy", F.col("cash_pct") * F.col("net_sales"))
            .withColumn("platform_dependency", F.coalesce("foodmandu_pct", F.lit(0.0)))
            .withColumn("credit_exposure", F.coalesce("credit_pct", F.lit(0.0))))
    fm = ffill_bfill(fm, FILLED_TOTALS)
    fm = fm.withColumn("stress", stress_label(F.col("profit_margin"), F.col("cogs_ratio"),
                                              F.col("margin_pressure")))
    return fm.select(*FM_COLUMNS)
