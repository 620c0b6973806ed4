"""Data-quality layer: source coverage (S1), completeness (A4), issue rules
(A5) and the one-line summary.  Each dataset is reduced by one global
aggregate (partial aggregation per task, then a single tiny merge)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import quantize

# Issue-rule thresholds and texts.
MEDIUM_BELOW = 0.3
FULL_WINDOW_MONTHS = 6
PER_FILE_MIN_PERIODS = 5
SCHEMA_ISSUE = ("schema", "Semi-structured Excel", "Low",
                "Headers irregular; values extracted via label/column mapping")


def required_columns(parties_type: str | None = None):
    """(dataset name, required columns) in report order."""
    return [("monthly_sales_2026", ["net_sales", "cash_pct"]),
            ("monthly_pl", ["sales_value", "cogs", "gross_profit", "profit"]),
            ("daily_sales", ["total_sales", "cash", "online"]),
            ("creditors", ["closing"]),
            ("debtors", ["closing"])]


def quality_inputs(sales: DataFrame, pl: DataFrame, daily: DataFrame, parties: DataFrame) -> dict:
    return {
        "monthly_sales_2026": sales.where(F.col("net_sales").isNotNull()),
        "monthly_pl": pl,
        "daily_sales": daily,
        "creditors": parties.where(F.col("type") == "creditor"),
        "debtors": parties.where(F.col("type") == "debtor"),
    }


def null_counts(datasets: dict) -> DataFrame:
    """(dataset, column, rows, nulls) for every required column."""
    parts = []
    for order, (name, cols) in enumerate(required_columns()):
        df = datasets[name]
        agg = df.agg(F.count(F.lit(1)).alias("rows"),
                     *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        long = agg.unpivot(["rows"], cols, "column", "nulls")
        parts.append(long.select(F.lit(order).alias("dataset_order"), F.lit(name).alias("dataset"),
                                 "column", "rows", "nulls"))
    return reduce(DataFrame.unionByName, parts)


def completeness(datasets: dict) -> DataFrame:
    """A4: 1 - mean null rate over required columns (0 for an empty set),
    evaluated as 1 - total nulls / (rows * columns)."""
    nc = null_counts(datasets)
    g = nc.groupBy("dataset_order", "dataset").agg(F.max("rows").alias("rows"), F.sum("nulls").alias("nulls"),
                                                    F.count("*").alias("n_cols"))
    comp = F.when(F.col("rows") == 0, F.lit(0.0)).otherwise(
        F.lit(1.0) - F.col("nulls").cast("double") / (F.col("rows") * F.col("n_cols")).cast("double"))
    return g.select("dataset", "rows", comp.alias("completeness"))


def source_coverage(pl: DataFrame) -> DataFrame:
    """Periods per entity and the load route they select."""
    g = pl.groupBy("entity").agg(F.count_distinct("period").alias("periods"))
    return g.withColumn("route", F.when(F.col("periods") >= PER_FILE_MIN_PERIODS, F.lit("per_file"))
                        .otherwise(F.lit("legacy")))


def issues(datasets: dict, pl: DataFrame, daily: DataFrame) -> DataFrame:
    """A5: empty datasets (High), missing-value rates (Medium below 30 %,
    else High; percent rounded half up), the coverage row and the schema row."""
    nc = null_counts(datasets)
    empty = (nc.groupBy("dataset_order", "dataset").agg(F.max("rows").alias("rows"))
               .where(F.col("rows") == 0)
               .select("dataset_order", "dataset", F.lit("Empty dataset").alias("issue"),
                       F.lit("High").alias("severity"), F.lit("No rows extracted").alias("detail")))
    rate = F.col("nulls").cast("double") / F.col("rows").cast("double")
    missing = (nc.where((F.col("rows") > 0) & (F.col("nulls") > 0))
                 .select("dataset_order", "dataset", F.lit("Missing values").alias("issue"),
                         F.when(rate < MEDIUM_BELOW, F.lit("Medium")).otherwise(F.lit("High")).alias("severity"),
                         F.concat(F.col("column"), F.lit(": "),
                                  quantize(rate * F.lit(100.0), 0).cast("bigint").cast("string"),
                                  F.lit("% missing")).alias("detail")))
    n_months = pl.select(F.count_distinct("period").alias("m")).scalar()
    n_days = daily.select(F.count_distinct("date").alias("d")).scalar()
    full = n_months >= FULL_WINDOW_MONTHS
    cov = pl.sparkSession.range(1).select(
        F.lit(90).alias("dataset_order"), F.lit("coverage").alias("dataset"),
        F.concat(F.when(full, F.lit("Full")).otherwise(F.lit("Partial")), F.lit(" "),
                 n_months.cast("string"), F.lit("-month window")).alias("issue"),
        F.when(full, F.lit("Low")).otherwise(F.lit("Medium")).alias("severity"),
        F.concat(F.lit("P&L for "), n_months.cast("string"), F.lit(" months loaded; daily grain for "),
                 n_days.cast("string"), F.lit(" days")).alias("detail"))
    schema = pl.sparkSession.range(1).select(
        F.lit(91).alias("dataset_order"), *[F.lit(v).alias(k) for k, v in
                                            zip(["dataset", "issue", "severity", "detail"], SCHEMA_ISSUE)])
    return reduce(DataFrame.unionByName, [empty, missing, cov, schema]).select(
        "dataset_order", "dataset", "issue", "severity", "detail")


def summary_line(pl: DataFrame, daily: DataFrame, found: DataFrame) -> DataFrame:
    """The report's one-line summary: workbooks (one per entity and month),
    months of P&L, days of daily sales and logged issues."""
    counts = [("Indexed ", pl.agg(F.count("*"))), (" workbooks. Monthly P&L months: ", pl.agg(F.count_distinct("period"))),
              (". Daily sales days: ", daily.agg(F.count_distinct("date"))), (". Issues logged: ", found.agg(F.count("*")))]
    text = F.concat(*[x for said, n in counts for x in (F.lit(said), n.scalar().cast("string"))], F.lit("."))
    return pl.sparkSession.range(1).select(text.alias("summary"))
