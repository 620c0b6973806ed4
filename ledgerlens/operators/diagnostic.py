"""Diagnostic layer: variance decomposition (D1), cost elasticity (A8/D2),
lag-1 Granger tests (D4) and root-cause notes (D5).  Per entity; every
window is partitioned by entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import cents
from ..functions.stats import quantize
from .descriptive import latest_two

# Variance components (label, column, note) in report order.
VARIANCE_COMPONENTS = [
    ("Sales Value Δ", "sales_value", "Revenue change"),
    ("COGS Δ", "cogs", "Cost pressure"),
    ("Gross Profit Δ", "gross_profit", "Sales Δ − COGS Δ"),
    ("Staff Salary Δ", "staff_salary", "Labour cost shift"),
    ("Profit Δ", "profit", "Bottom-line change"),
]
MARGIN_PRESSURE_NOTE = ("Margin Pressure", "COGS MoM% − Sales MoM%")

# Granger pairs (cause, effect, label) and texts.
GRANGER_PAIRS = [
    ("cogs", "sales_value", "COGS Granger-causes Sales"),
    ("sales_value", "cogs", "Sales Granger-causes COGS"),
    ("margin_pressure", "profit_margin", "Margin pressure Granger-causes Profit margin"),
]
GRANGER_EVIDENCE = "Evidence of causation"
GRANGER_NONE = "No significant causation at 10%"
GRANGER_SHORT_LABEL = "Granger (COGS → Sales)"
GRANGER_SHORT = "Insufficient data (n<4)"
GRANGER_ALPHA = 0.10
GRANGER_MIN_ROWS = 4


def variance_decomposition(fm: DataFrame) -> DataFrame:
    """Latest minus previous of five P&L lines (NULL counts as 0) and the
    latest margin pressure; entities with fewer than two rows give nothing."""
    lt = latest_two(fm)
    aggs = [F.max("rn").alias("n_rows"),
            F.max(F.when(F.col("rn") == 1, F.col("margin_pressure"))).alias("mp")]
    for _, c, _ in VARIANCE_COMPONENTS:
        aggs += [F.max(F.when(F.col("rn") == 1, F.coalesce(F.col(c), F.lit(0.0)))).alias(f"{c}__l"),
                 F.max(F.when(F.col("rn") == 2, F.coalesce(F.col(c), F.lit(0.0)))).alias(f"{c}__p")]
    g = lt.groupBy("entity").agg(*aggs).where(F.col("n_rows") >= 2)
    rows = [F.struct(F.lit(i).alias("component_order"), F.lit(label).alias("component"),
                     (F.col(f"{c}__l") - F.col(f"{c}__p")).alias("value"), F.lit(note).alias("note"))
            for i, (label, c, note) in enumerate(VARIANCE_COMPONENTS)]
    rows.append(F.struct(F.lit(len(rows)).alias("component_order"), F.lit(MARGIN_PRESSURE_NOTE[0]).alias("component"),
                         F.col("mp").alias("value"), F.lit(MARGIN_PRESSURE_NOTE[1]).alias("note")))
    return g.select("entity", F.inline(F.array(*rows)))


def cost_elasticity(pl: DataFrame, min_rows: int = 3) -> DataFrame:
    """OLS cogs ~ sales per entity from exact sums (cents, DECIMAL for
    the second moments), so no cancellation: slope = Sxy/Sxx, intercept =
    mean(y) - slope*mean(x), R^2 = Sxy^2/(Sxx*Syy) (NULL if Syy = 0),
    elasticity = slope*mean(x)/mean(y).  Fewer than ``min_rows`` -> NULLs."""
    d = "decimal(38,0)"
    rows = pl.where(F.col("sales_value").isNotNull() & F.col("cogs").isNotNull())
    x, y = cents("sales_value"), cents("cogs")
    g = rows.groupBy("entity").agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x.cast(d) * x.cast(d)).alias("sxx"), F.sum(y.cast(d) * y.cast(d)).alias("syy"),
        F.sum(x.cast(d) * y.cast(d)).alias("sxy"))
    n = F.col("n").cast(d)
    cxx = (n * F.col("sxx") - F.col("sx").cast(d) * F.col("sx").cast(d)).cast("double")
    cyy = (n * F.col("syy") - F.col("sy").cast(d) * F.col("sy").cast(d)).cast("double")
    cxy = (n * F.col("sxy") - F.col("sx").cast(d) * F.col("sy").cast(d)).cast("double")
    ok = F.col("n") >= min_rows
    slope = F.when(ok & (cxx != 0), cxy / cxx)
    mx = F.col("sx").cast("double") / F.lit(100.0) / F.col("n").cast("double")
    my = F.col("sy").cast("double") / F.lit(100.0) / F.col("n").cast("double")
    out = g.select("entity", "n", slope.alias("slope"), mx.alias("mx"), my.alias("my"),
                   F.when(ok & (cxx != 0) & (cyy != 0), (cxy / cxx) * (cxy / cyy)).alias("r2"))
    return out.select(
        "entity", "n",
        F.when(F.col("my") != 0, F.col("slope") * F.col("mx") / F.col("my")).alias("elasticity"),
        "r2", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def _granger_pairs(fm: DataFrame, keep_null_lags: bool) -> DataFrame:
    """Lag-1 F tests without intercept, all pairs in one pass: each row is
    exploded into one row per (cause, effect) pair and every window runs
    over (entity, pair).

    Rows of the entity (sales and cogs present) in period order; y_t is
    regressed on y_{t-1} (restricted) and on y_{t-1}, x_{t-1}
    (unrestricted, 2x2 normal equations; singular -> restricted fit).
    Residual sums are taken in a second pass over the rows with the
    coefficients attached by a whole-group window (no cancellation)."""
    pairs = F.array(*[F.struct(F.lit(i).alias("test_order"), F.lit(label).alias("test"),
                               F.col(effect).cast("double").alias("y"), F.col(cause).cast("double").alias("x"))
                      for i, (cause, effect, label) in enumerate(GRANGER_PAIRS)])
    base = fm.where(F.col("sales_value").isNotNull() & F.col("cogs").isNotNull())
    t = base.select("entity", "period", F.inline(pairs))
    w = Window.partitionBy("entity", "test_order").orderBy("period")
    whole = Window.partitionBy("entity", "test_order")
    t = (t.withColumn("yl", F.lag("y").over(w)).withColumn("xl", F.lag("x").over(w))
          .withColumn("n", F.count(F.lit(1)).over(whole))
          .withColumn("rn", F.row_number().over(w)))
    t = t.where(F.col("rn") > 1)  # y[1:] against y[:-1], x[:-1]
    usable = F.col("y").isNotNull() & F.col("yl").isNotNull() & F.col("xl").isNotNull()
    # Parity mode: a NULL in any lagged value poisons the fit (F = 0, p = 1).
    t = t.withColumn("poisoned", F.max((~usable).cast("int")).over(whole) > 0)
    if not keep_null_lags:
        t = t.where(usable)
    y, yl, xl = F.col("y"), F.col("yl"), F.col("xl")
    sums = {"a": yl * yl, "b": yl * xl, "c": xl * xl, "d": yl * y, "e": xl * y}
    for k, e in sums.items():
        t = t.withColumn(k, F.sum(e).over(whole))
    a, b, c, dd, ee = (F.col(k) for k in "abcde")
    det = a * c - b * b
    t = (t.withColumn("br", F.when(a != 0, dd / a).otherwise(F.lit(0.0)))
          .withColumn("b1", F.when(det != 0, (c * dd - b * ee) / det))
          .withColumn("b2", F.when(det != 0, (a * ee - b * dd) / det)))
    res_r = y - F.col("br") * yl
    res_u = F.when(F.col("b1").isNotNull(), y - F.col("b1") * yl - F.col("b2") * xl).otherwise(res_r)
    g = t.groupBy("entity", "test_order", "test").agg(
        F.max("n").alias("n"), F.max(F.col("poisoned").cast("int")).alias("poisoned"),
        F.sum(res_r * res_r).alias("ssr_r"), F.sum(res_u * res_u).alias("ssr_u"))
    dof = F.greatest(F.col("n") - 3, F.lit(1)).cast("double")
    f = F.when(F.col("ssr_u") > 0, (F.col("ssr_r") - F.col("ssr_u")) / (F.col("ssr_u") / dof)).otherwise(F.lit(0.0))
    if keep_null_lags:
        f = F.when(F.col("poisoned") == 1, F.lit(0.0)).otherwise(f)
    p = F.when(F.col("f") > 0, F.least(F.greatest(F.exp(-F.col("f") / F.lit(2.0)), F.lit(0.0)), F.lit(1.0))) \
        .otherwise(F.lit(1.0))
    out = g.withColumn("f", f).withColumn("p", p)
    return out.select("entity", "test_order", "test",
                      quantize(F.col("f"), 3).alias("f_stat"), quantize(F.col("p"), 4).alias("p_approx"),
                      F.col("n").cast("bigint").alias("n"),
                      F.when(F.col("p") < GRANGER_ALPHA, F.lit(GRANGER_EVIDENCE))
                       .otherwise(F.lit(GRANGER_NONE)).alias("result"))


def granger_lag1(fm: DataFrame, keep_null_lags: bool = False) -> DataFrame:
    """Three lag-1 Granger tests per entity; fewer than four usable rows
    give one 'Insufficient data' row.  F rounded to 3, p to 4 decimals;
    p ~ exp(-F/2) (1 when F <= 0); p < 0.10 -> evidence."""
    base = fm.where(F.col("sales_value").isNotNull() & F.col("cogs").isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy("entity"))
    counted = base.withColumn("n_rows", n)
    short = (counted.where(F.col("n_rows") < GRANGER_MIN_ROWS).groupBy("entity")
             .agg(F.max("n_rows").alias("n"))
             .select("entity", F.lit(0).alias("test_order"), F.lit(GRANGER_SHORT_LABEL).alias("test"),
                     F.lit(None).cast("double").alias("f_stat"), F.lit(None).cast("double").alias("p_approx"),
                     F.col("n").cast("bigint").alias("n"), F.lit(GRANGER_SHORT).alias("result")))
    tests = _granger_pairs(counted.where(F.col("n_rows") >= GRANGER_MIN_ROWS).drop("n_rows"), keep_null_lags)
    return short.unionByName(tests)


# Root-cause note texts.
NOTE_PRESSURE = "COGS grew faster than sales — margin compression is a primary stress driver."


def _money0(c: Column) -> Column:
    return F.format_number(c, 0)


def root_cause_notes(fm: DataFrame, elasticity: DataFrame, parties: DataFrame,
                     currency: str = "NPR") -> DataFrame:
    """Ordered notes per entity: margin pressure > 0; COGS rose MoM;
    the elasticity sentence; the top creditor of the latest period."""
    var = variance_decomposition(fm)
    v = var.groupBy("entity").agg(
        F.max(F.when(F.col("component") == MARGIN_PRESSURE_NOTE[0], F.col("value"))).alias("mp"),
        F.max(F.when(F.col("component") == VARIANCE_COMPONENTS[1][0], F.col("value"))).alias("cogs_delta"))
    cred = parties.where(F.col("type") == "creditor")
    latest = cred.groupBy("entity").agg(F.max("period").alias("period"))
    top = (cred.join(latest, ["entity", "period"], "left_semi")
               .groupBy("entity").agg(F.max_by(F.struct("party", "closing"),
                                               F.struct("closing", F.col("party"))).alias("top")))
    ents = fm.select("entity").distinct()
    j = (ents.join(v, "entity", "left").join(elasticity.select("entity", "elasticity", "r2"), "entity", "left")
             .join(top, "entity", "left"))
    notes = [
        (0, F.when(F.col("mp") > 0, F.lit(NOTE_PRESSURE))),
        (1, F.when(F.col("cogs_delta") > 0, F.concat(F.lit(f"COGS increased by {currency} "),
                                                     _money0(F.col("cogs_delta")),
                                                     F.lit(" MoM — investigate purchase-cost elasticity.")))),
        (2, F.when(F.col("elasticity").isNotNull() & ~F.isnan("elasticity"),
                   F.concat(F.lit("Estimated COGS–sales elasticity ≈ "), F.format_number("elasticity", 2),
                            F.lit(" (R²="), F.coalesce(F.format_number("r2", 2), F.lit("nan")),
                            F.lit("): costs move closely with revenue.")))),
        (3, F.when(F.col("top").isNotNull(),
                   F.concat(F.lit("Top creditor concentration: "), F.col("top.party"), F.lit(f" ({currency} "),
                            _money0(F.col("top.closing")), F.lit(")."))))]
    arr = F.array(*[F.struct(F.lit(i).alias("note_order"), n.alias("note")) for i, n in notes])
    return (j.select("entity", F.inline(arr)).where(F.col("note").isNotNull()))
