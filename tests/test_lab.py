"""The model lab on small models: predictions, failed models, importance, Shapley values; and the plans of its inputs."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import lab, shap
from ledgerlens.plans import registry
from ledgerlens.sources.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return lab.lab_table(registry.fm_of(Tables(spark, SF)))


def small_models():
    keep = {"Logistic Regression", "Random Forest"}
    return [m for m in lab.classifiers(n_trees=5, gbt_iter=2, xgb_iter=2) if m[0] in keep]


def test_registered_models_have_the_reference_sizes(spark):
    models = {name: make(100) for name, make, _ in lab.classifiers()}
    assert models["Random Forest"].getNumTrees() == 200 and models["Random Forest"].getMaxDepth() == 3
    assert models["Gradient Boosting"].getMaxIter() == 100 and models["XGBoost"].getMaxIter() == 120
    daily = {name: make(100, 1.0) for name, make in lab.regressors()}
    assert daily["Random Forest Regressor"].getNumTrees() == 200 and daily["XGBoost Regressor"].getMaxIter() == 120


def test_every_row_is_predicted_once_and_failures_become_rows(spark, table):
    class Broken:
        def fit(self, _):
            raise RuntimeError("no fit")

    errors = {}
    models = [*small_models(), ("Broken", lambda n: Broken(), False)]
    found = lab.cv_predictions(table, models, errors=errors)
    n = table.count()
    assert {r["model"]: r["count"] for r in found.groupBy("model").count().collect()} == {"Logistic Regression": n, "Random Forest": n}
    assert found.select("model", "entity", "period").distinct().count() == 2 * n
    rows = {r["model"]: r for r in lab.comparison(lab.classification_metrics(found), errors).collect()}
    assert rows["Broken"]["score"] is None and rows["Broken"]["error"] == "no fit" and rows["Random Forest"]["error"] is None
    with pytest.raises(RuntimeError):
        lab.cv_predictions(table, models)


def test_best_model_takes_the_later_of_equals(spark):
    m = spark.createDataFrame([("a", 0.9, 0), ("b", 0.9, 1), ("c", 0.5, 2)], "model string, accuracy double, model_order int")
    assert lab.best_model(m) == "b"


def test_auc_ranges_change_nothing(spark):
    rng = np.random.default_rng(0)
    rows = [("g", int(y), float(s), int(s > 0.5)) for y, s in zip(rng.integers(0, 2, 700), np.round(rng.random(700), 2))]
    d = spark.createDataFrame(rows, "model string, label int, proba double, predicted int")
    got = lab.classification_metrics(d, ("model",)).first()["ROC_AUC"]
    pos, neg = [r[2] for r in rows if r[1]], [r[2] for r in rows if not r[1]]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert got == pytest.approx(want, abs=1e-12)


def test_shapley_values_add_up_and_match_all_subsets(spark, table):
    model, scored = lab.refit(table, "Random Forest", small_models())
    imp = [r["importance"] for r in lab.importance(model, spark=spark).collect()]
    assert imp == sorted(imp, reverse=True) and sum(imp) == pytest.approx(1)
    got = shap.shap_values(model, scored, lab.FEATURE_COLS)
    j = got.join(scored.select("entity", "period", "proba"), ["entity", "period"])
    assert j.where(F.abs(F.col("score") - F.col("proba")) > 1e-9).count() == 0 and got.count() == table.count()
    leaves = shap.leaves_of(model)
    x = np.array([[r[c] for c in lab.FEATURE_COLS] for r in scored.limit(5).collect()], float)
    value = shap.contributions(leaves, x)
    used = sorted({f for leaf in leaves for f in leaf.path})
    for row, phi in zip(x, value):
        def worth(known):
            return sum(leaf.value * math.prod((low < row[f] <= high) if f in known else share for f, (low, high, share) in leaf.path.items()) for leaf in leaves)
        for f in used[:3]:
            others = [g for g in used if g != f]
            want = 0.0
            for size in range(len(others) + 1):
                chance = math.factorial(size) * math.factorial(len(used) - size - 1) / math.factorial(len(used))
                want += sum(chance * (worth({*s, f}) - worth(set(s))) for s in itertools.combinations(others, size))
            assert phi[f] == pytest.approx(want, abs=1e-9)


def test_shapley_values_of_long_paths_equal_subset_sums():
    rng = np.random.default_rng(5)
    x = rng.random((4, 14))
    leaves = [shap.Leaf(float(rng.normal()), {int(f): (0.0, float(rng.random()), float(rng.random())) if rng.random() < 0.5 else (float(rng.random()), 1.0, float(rng.random()))
                                              for f in rng.permutation(14)[:n]}) for n in (0, 1, 2, 5, 11, 12)]
    leaves.append(shap.Leaf(2.0, {0: (0.0, 2.0, 0.0), 1: (-1.0, 0.0, 0.0)}))  # turns that no training row took
    got = shap.contributions(leaves, x)
    want = np.zeros(x.shape)
    for leaf in leaves:
        n = len(leaf.path)
        for i, row in enumerate(x):
            met = {f: float(low < row[f] <= high) for f, (low, high, _) in leaf.path.items()}
            for f in leaf.path:
                others = [g for g in leaf.path if g != f]
                for size in range(n):
                    chance = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                    for known in itertools.combinations(others, size):
                        want[i, f] += leaf.value * (met[f] - leaf.path[f][2]) * chance * math.prod(met[g] if g in known else leaf.path[g][2] for g in others)
    assert np.allclose(got, want, atol=1e-12)


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_shapley_values_of_deep_trees_add_up(spark, kind):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor
    rng = np.random.default_rng(6)
    x = rng.random((500, 10))
    y = ((x[:, 0] * x[:, 1] + x[:, 2] * np.sin(9 * x[:, 3]) + 0.1 * rng.normal(size=500)) > 0.4).astype(float)
    cols = [f"x{i}" for i in range(10)]
    d = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], ["id", *cols, "label"])
    d = VectorAssembler(inputCols=cols, outputCol="features").transform(d)
    if kind == "forest":
        model = RandomForestClassifier(numTrees=3, maxDepth=12, seed=1).fit(d)
        scored = model.transform(d).withColumn("want", vector_to_array("probability")[1])
    else:
        model = GBTRegressor(maxIter=3, maxDepth=12, seed=1).fit(d)
        scored = model.transform(d).withColumn("want", F.col("prediction"))
    assert max(len(leaf.path) for leaf in shap.leaves_of(model)) >= 6
    got = shap.shap_values(model, scored, cols, ("id",)).join(scored.select("id", "want"), "id")
    assert got.count() == 500 and got.where(F.abs(F.col("score") - F.col("want")) > 1e-9).count() == 0


@pytest.mark.parametrize("name, scans", [("feature_matrix", 1), ("stress_label", 1), ("variance_decomposition", 1)])
def test_lineitem_is_scanned_once(spark, name, scans):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(re.findall(r"FileScan parquet [^\n]*lineitem", plan)) == scans
