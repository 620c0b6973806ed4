"""One-entity runs reproduce the reference's exported numbers (FIXTURES.md)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixtures import ACTIONS, DAILY_ROWS, PL_ROWS, SALES_ROWS
from ledgerlens.operators import diagnostic as diag
from ledgerlens.operators import features as feat
from ledgerlens.operators import lab, predictive, prescriptive
from ledgerlens.sources.domain import PL_COLUMNS, ratio


def pl_df(spark):
    cols = ["period", "month", "sales_value", "total_incomes", "cogs", "gross_profit", "operational_expenses",
            "staff_salary", "foodmandu_charges", "total_expenses", "profit", "bread_income"]
    d = spark.createDataFrame(PL_ROWS, cols).withColumn("entity", F.lit(1).cast("bigint"))
    d = (d.withColumn("gross_margin", ratio(F.col("gross_profit"), F.col("total_incomes")))
          .withColumn("cogs_ratio", ratio(F.col("cogs"), F.col("total_incomes")))
          .withColumn("profit_margin", ratio(F.col("profit"), F.col("total_incomes")))
          .withColumn("salary_to_sales", ratio(F.col("staff_salary"), F.col("sales_value"))))
    return d.select(*PL_COLUMNS)


def fm_df(spark):
    cols = ["period", *feat.SALES_FEATURES, "creditor_total", "debtor_total", "wastage_units"]
    s = spark.createDataFrame(SALES_ROWS, cols).withColumn("entity", F.lit(1).cast("bigint"))
    parties = s.select("entity", "period", F.lit("creditor").alias("type"), F.lit("c").alias("party"),
                       F.col("creditor_total").alias("closing")).unionByName(
        s.select("entity", "period", F.lit("debtor").alias("type"), F.lit("d").alias("party"),
                 F.col("debtor_total").alias("closing")))
    waste = s.select("entity", "period", F.col("wastage_units").alias("total"))
    return feat.feature_matrix(pl_df(spark), s, parties, waste)


def daily_df(spark):
    rows = [(1, dt.date.fromisoformat(d), *rest) for d, *rest in DAILY_ROWS]
    d = spark.createDataFrame(rows, "entity bigint, date date, cash double, online double, credit double, "
                                    "total_sales double, customers bigint, dine_in_sales double")
    return (d.withColumn("avg_ticket", F.col("dine_in_sales") / F.col("customers"))
             .withColumn("day_of_week", F.date_format("date", "EEEE"))
             .withColumn("dow", F.weekday("date").cast("int")))


def test_stress_labels_and_mom(spark):
    rows = fm_df(spark).orderBy("period").collect()
    assert [r["stress"] for r in rows] == [0, 1, 1, 1, 0, 1]
    assert rows[0]["sales_mom_pct"] is None and rows[0]["margin_pressure"] is None
    assert rows[1]["sales_mom_pct"] == pytest.approx(-0.10545361810926845, abs=1e-12)
    assert rows[1]["margin_pressure"] == pytest.approx(0.08018834756590254, abs=1e-12)
    assert rows[4]["profit_mom_pct"] == pytest.approx(3.2259775320039266, abs=1e-10)
    assert rows[0]["liquidity_proxy"] == pytest.approx(1799433.16, abs=1e-6)


def test_cost_elasticity(spark):
    r = diag.cost_elasticity(pl_df(spark)).first()
    assert r["elasticity"] == pytest.approx(1.1756649739, abs=1e-7)
    assert r["r2"] == pytest.approx(0.7975652471, abs=1e-7)
    assert r["slope"] == pytest.approx(0.6612126653, abs=1e-7)
    assert r["intercept"] == pytest.approx(-217296.92559, abs=1e-2)


def test_granger(spark):
    got = {r["test"]: r for r in diag.granger_lag1(fm_df(spark)).collect()}
    a = got["COGS Granger-causes Sales"]
    assert (a["f_stat"], a["p_approx"]) == (0.0, 0.9998)
    b = got["Sales Granger-causes COGS"]
    assert (b["f_stat"], b["p_approx"]) == (0.858, 0.6513)
    assert b["result"] == "No significant causation at 10%"
    parity = {r["test"]: r for r in diag.granger_lag1(fm_df(spark), keep_null_lags=True).collect()}
    c = parity["Margin pressure Granger-causes Profit margin"]
    assert (c["f_stat"], c["p_approx"]) == (0.0, 1.0)


def test_topsis_actions(spark):
    alts = spark.createDataFrame(ACTIONS, ["action", "liquidity", "profitability", "feasibility", "risk_reduction"])
    got = {r["action"]: r["topsis_score"] for r in prescriptive.topsis(alts).collect()}
    want = [0.513999, 0.456550, 0.504187, 0.504440, 0.495560]
    for (name, *_), w in zip(ACTIONS, want):
        assert got[name] == pytest.approx(w, abs=1e-6)


def test_daily_features(spark):
    f = predictive.daily_features(daily_df(spark)).orderBy("date").collect()
    assert len(f) == 24
    r = f[0]
    assert r["date"] == dt.date(2026, 5, 8)
    assert (r["lag1"], r["lag7"]) == (55581.0, 77059.0)
    assert r["roll7"] == pytest.approx(60948.428571, abs=1e-6)
    assert r["roll7_std"] == pytest.approx(26752.476040, abs=1e-6)


FORECAST = [
    ("2026-06-01", 54220.2575, 19433.4377, 89007.0774, 0.372560),
    ("2026-06-02", 64983.5506, 30196.7308, 99770.3704, 0.235270),
    ("2026-06-03", 53038.2053, 18251.3855, 87825.0251, 0.389151),
    ("2026-06-04", 69420.5934, 34633.7735, 104207.4132, 0.188061),
    ("2026-06-05", 85210.3204, 50423.5006, 119997.1403, 0.071221),
    ("2026-06-06", 97648.5725, 62861.7527, 132435.3923, 0.027116),
    ("2026-06-07", 92904.7930, 58117.9732, 127691.6128, 0.040040),
]


def test_forecast_analytic(spark):
    rows = predictive.forecast_daily(daily_df(spark)).orderBy("step").collect()
    assert len(rows) == 7
    for r, (d, point, p10, p90, prob) in zip(rows, FORECAST):
        assert str(r["date"]) == d
        assert r["forecast"] == pytest.approx(point, abs=1e-3)
        assert r["p10"] == pytest.approx(p10, abs=1e-3)
        assert r["p90"] == pytest.approx(p90, abs=1e-3)
        assert r["cash_flow_stress_prob"] == pytest.approx(prob, abs=2e-6)


def test_forecast_simulated_close_to_analytic(spark):
    a = {r["step"]: r for r in predictive.forecast_daily(daily_df(spark)).collect()}
    s = {r["step"]: r for r in predictive.forecast_daily_sim(daily_df(spark)).collect()}
    sigma = 27144.299737
    for k, r in s.items():
        assert abs(r["p50"] - a[k]["p50"]) < 0.25 * sigma
        assert abs(r["p10"] - a[k]["p10"]) < 0.3 * sigma
        assert abs(r["cash_flow_stress_prob"] - a[k]["cash_flow_stress_prob"]) < 0.07


def test_daily_regression_linear_models(spark):
    models = [m for m in lab.regressors() if m[0] in ("Linear Regression", "Ridge")]
    _, m = lab.daily_regression(predictive.daily_features(daily_df(spark)), models)
    got = {r["model"]: r for r in m.collect()}
    assert got["Linear Regression"]["R2"] == pytest.approx(-0.7505617069, abs=1e-6)
    assert got["Linear Regression"]["MAE"] == pytest.approx(17253.942724, abs=1e-3)
    assert got["Ridge"]["R2"] == pytest.approx(-0.6983175658, abs=1e-5)


def test_logistic_leave_one_out(spark):
    from pyspark.sql import Window
    fm = lab.impute_features(fm_df(spark))
    t = (fm.withColumn("label", F.col("stress").cast("double")).withColumn("w", F.lit(1.0))
           .withColumn("fold", F.row_number().over(Window.orderBy("period")) - 1))
    t = lab._assemble(t, lab.FEATURE_COLS)
    logistic = [m for m in lab.classifiers() if m[0] == "Logistic Regression"]
    pred = lab.cv_predictions(t, logistic, folds=6, leaky_scaling=True)
    m = lab.classification_metrics(pred).first()
    assert m["accuracy"] == pytest.approx(4 / 6, abs=1e-9)
    assert m["F1"] == pytest.approx(0.8, abs=1e-9)
    assert m["ROC_AUC"] == pytest.approx(0.625, abs=1e-9)
