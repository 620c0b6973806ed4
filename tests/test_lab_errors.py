"""A regressor that fails gives an error row, and the comparison survives its CSV export."""

import datetime as dt

from pyspark.ml.regression import LinearRegression

from ledgerlens.operators import lab
from ledgerlens.operators import predictive as pred
from ledgerlens.sources import sinks


class Broken:
    def fit(self, train):
        raise ValueError("no fit\nsecond line")


def test_failed_regressors_have_error_rows(spark):
    days = [(1, dt.date(2024, 1, 1) + dt.timedelta(i), 0.0, 0.0, 0.0, 100.0 + i % 7 + i / 10, 3, 1.0, 1.0, "x", i % 7) for i in range(40)]
    daily = spark.createDataFrame(days, "entity long, date date, cash double, online double, credit double, total_sales double, customers long, dine_in_sales double, avg_ticket double, day_of_week string, dow int")
    line = ("line", lambda n, s: LinearRegression(featuresCol="features", labelCol="total_sales"))
    errors = {}
    _, metrics = lab.daily_regression(pred.daily_features(daily), [("broken", lambda n, s: Broken()), line], errors)
    assert errors == {"broken": (0, "no fit")} and [r.model for r in metrics.collect()] == ["line"]
    none = spark.createDataFrame([], "model_order int, model string, accuracy double, F1 double, ROC_AUC double")
    table = lab.full_comparison(none, metrics, None, errors)
    rows = {r.model: r for r in sinks.csv_roundtrip(table, "model_comparison").collect()}
    assert rows["broken"].error == "no fit" and rows["broken"].score is None and rows["broken"].model_order == 10
    assert rows["line"].error is None and rows["line"].score is not None and rows["line"].metric_primary == rows["broken"].metric_primary
    errors = {}
    _, metrics = lab.daily_regression(pred.daily_features(daily), [("broken", lambda n, s: Broken())], errors)
    assert metrics.count() == 0 and list(errors) == ["broken"]
