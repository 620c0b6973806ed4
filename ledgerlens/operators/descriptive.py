"""Descriptive layer: KPI change (F3), channel mix (P1), sales trend (P2),
describe (A3), volatility (A6), day-of-week seasonality (A7) and the
stock-out proxy (A9).  All per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import cents, exact_mean, exact_std, to_double
from ..functions.stats import percentiles, quantize

# KPI rows (label, feature column) in report order.
KPI_METRICS = [
    ("Net Sales (latest)", "net_sales"),
    ("Sales Value", "sales_value"),
    ("Gross Margin", "gross_margin"),
    ("COGS Ratio", "cogs_ratio"),
    ("Profit", "profit"),
    ("Profit Margin", "profit_margin"),
    ("Staff / Sales", "salary_to_sales"),
    ("Cash Sales %", "cash_pct"),
    ("Platform Dependency", "platform_dependency"),
    ("Creditor Total", "creditor_total"),
    ("Debtor Total", "debtor_total"),
    ("Wastage Units", "wastage_units"),
]

# Columns summarised by ``describe``.
DESCRIBE_PL = ["sales_value", "cogs", "gross_profit", "profit", "gross_margin", "staff_salary"]
DESCRIBE_DAILY = ["total_sales", "cash", "online", "credit", "customers"]
DESCRIBE_FEATURES = ["sales_value", "gross_margin", "cogs_ratio", "profit_margin", "salary_to_sales",
                     "cash_pct", "platform_dependency", "wastage_units", "creditor_total", "debtor_total"]


def latest_two(df: DataFrame, order: str = "period") -> DataFrame:
    """Latest (rn=1) and previous (rn=2) row per entity.  The
    ``row_number() <= 2`` filter becomes a WindowGroupLimit, which also
    trims each partition before any shuffle."""
    w = Window.partitionBy("entity").orderBy(F.col(order).desc())
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2)


def kpi_change(fm: DataFrame) -> DataFrame:
    """latest / previous / change for 12 KPIs; previous = latest when the
    entity has one row; change = (latest - previous) / |previous|, NULL when
    either is NULL or previous is 0."""
    lt = latest_two(fm)
    aggs = [F.max("rn").alias("n_rows")]
    for _, c in KPI_METRICS:
        aggs += [F.max(F.when(F.col("rn") == 1, F.col(c))).alias(f"{c}__l"),
                 F.max(F.when(F.col("rn") == 2, F.col(c))).alias(f"{c}__p")]
    g = lt.groupBy("entity").agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(i).alias("metric_order"), F.lit(label).alias("metric"),
                 F.col(f"{c}__l").cast("double").alias("latest"),
                 F.when(F.col("n_rows") == 1, F.col(f"{c}__l")).otherwise(F.col(f"{c}__p")).cast("double")
                 .alias("previous"))
        for i, (label, c) in enumerate(KPI_METRICS)])
    out = g.select("entity", F.inline(rows))
    lat, prev = F.col("latest"), F.col("previous")
    return out.withColumn("change_pct", F.when(lat.isNotNull() & prev.isNotNull() & (prev != 0),
                                               (lat - prev) / F.abs(prev)))


def channel_mix(sales: DataFrame) -> DataFrame:
    """Rows with net sales, channel shares only."""
    return (sales.where(F.col("net_sales").isNotNull())
                 .select("entity", "period", "month", "net_sales", "cash_pct", "foodmandu_pct",
                         "pokhara_pct", "credit_pct"))


def sales_trend(sales: DataFrame) -> DataFrame:
    """Net sales by (year, month) for every year there is, NULLs dropped.
    The long form of one sales column per year, without a list of years."""
    return (sales.where(F.col("net_sales").isNotNull())
                 .select("entity", F.substring("period", 1, 4).cast("int").alias("year"), "month", "month_num",
                         F.col("net_sales").alias("sales")))


def describe(df: DataFrame, cols: list[str], key: str = "entity") -> DataFrame:
    """A3: count/mean/std/min/quartiles/max per (entity, feature) in one
    aggregation pass after an unpivot.  Quartiles are exact and
    interpolated; mean and std are rounded to 1e-4."""
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [key], cols, "feature", "value")
    g = long.groupBy(key, "feature").agg(
        F.count("value").alias("count"),
        quantize(F.avg("value"), 4).alias("mean"),
        quantize(F.stddev_samp("value"), 4).alias("std"),
        F.min("value").alias("min"),
        percentiles("value").alias("q"),
        F.max("value").alias("max"))
    return g.select(key, "feature", "count", "mean", "std", "min",
                    F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def sales_volatility(trend: DataFrame) -> DataFrame:
    """Coefficient of variation of monthly net sales per (entity, year).
    Net sales are exact at 1e-4, so mean and std come from exact sums."""
    u = F.round(F.col("sales") * F.lit(10000.0)).cast("bigint")
    g = trend.groupBy("entity", "year").agg(F.count("sales").alias("n"), F.sum(u).alias("sx"),
                                            F.sum(u.cast("decimal(38,0)") * u.cast("decimal(38,0)")).alias("sxx"))
    mean = exact_mean(F.col("n"), F.col("sx"), 4)
    std = exact_std(F.col("n"), F.col("sx"), F.col("sxx"), 4)
    return g.select("entity", "year", "n", mean.alias("mean"), std.alias("std"),
                    F.try_divide(std, mean).alias("cv"))


def daily_volatility(daily: DataFrame) -> DataFrame:
    """A6 (daily): CV of daily total sales per entity."""
    u = cents("total_sales")
    ud = u.cast("decimal(38,0)")
    g = daily.groupBy("entity").agg(F.count("total_sales").alias("n"), F.sum(u).alias("sx"),
                                    F.sum(ud * ud).alias("sxx"))
    mean = exact_mean(F.col("n"), F.col("sx"), 2)
    std = exact_std(F.col("n"), F.col("sx"), F.col("sxx"), 2)
    return g.select("entity", "n", mean.alias("mean"), std.alias("std"), F.try_divide(std, mean).alias("cv"))


def dow_seasonality(daily: DataFrame) -> DataFrame:
    """Mean total sales per (entity, Monday-0 weekday), the entity's
    overall mean and their ratio (the forecast's seasonal factor)."""
    u = cents("total_sales")
    by_dow = daily.groupBy("entity", "dow").agg(F.count("*").alias("n"), F.sum(u).alias("sx"))
    w = Window.partitionBy("entity")
    out = (by_dow.withColumn("n_all", F.sum("n").over(w)).withColumn("sx_all", F.sum("sx").over(w))
           .select("entity", "dow",
                   exact_mean(F.col("n"), F.col("sx"), 2).alias("dow_mean"),
                   exact_mean(F.col("n_all"), F.col("sx_all"), 2).alias("overall_mean")))
    return out.withColumn("seasonal", F.try_divide(F.col("dow_mean"), F.col("overall_mean")))


def stockout_proxy(cat: DataFrame, top: int = 10) -> DataFrame:
    """Category share of value and risk = clip(100*share, 0, 100); the
    top ``top`` categories per entity (ties by category name)."""
    w = Window.partitionBy("entity")
    s = cat.withColumn("total2", F.sum(cents("value")).over(w))
    total = to_double(F.col("total2"), 2)
    s = s.withColumn("share", F.when(total != 0, F.col("value") / total).otherwise(F.lit(0.0)))
    s = s.withColumn("stockout_risk_score", F.least(F.greatest(F.col("share") * F.lit(100.0), F.lit(0.0)),
                                                    F.lit(100.0)))
    r = Window.partitionBy("entity").orderBy(F.col("stockout_risk_score").desc(), F.col("category"))
    return (s.withColumn("rank", F.row_number().over(r)).where(F.col("rank") <= top)
             .select("entity", "rank", "category", "qty", "value", "share", "stockout_risk_score"))
