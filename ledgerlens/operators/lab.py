"""Model lab (M1-M14) on MLlib.

Re-aimed from one business's six months to entity x period rows: one
pooled model per algorithm, cross-validated with folds by entity hash
(leave-one-entity-group-out), so no entity's months leak between train and
test.  With a single entity and ``folds = rows`` the same code performs
the reference's leave-one-out.

The fold loop runs on the driver, as MLlib's CrossValidator does; every fit
and every metric is a distributed Spark job over the whole table.  The
assembled training table is checkpointed to the shared checkpoint folder,
which cuts the feature-matrix lineage before the iterative fits."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import cents
from ..session import cut_lineage

# Model features of the monthly stress task.
FEATURE_COLS = ["sales_value", "cogs_ratio", "gross_margin", "profit_margin", "salary_to_sales", "cash_pct",
                "platform_dependency", "credit_exposure", "staff_salary", "operational_expenses"]
DAILY_FEATURE_COLS = ["lag1", "lag7", "roll7", "roll7_std", "dow"]

CLASS_TASK = "Financial Stress Classification"
REG_TASK = "Daily Sales Forecasting"
N_FOLDS = 5
TRAIN_SHARE = 0.75
MIN_DAILY_ROWS = 8


# ------------------------------------------------------------------ P4 imputation
def impute_features(fm: DataFrame, cols=FEATURE_COLS) -> DataFrame:
    """DOUBLE coercion, NULL -> the entity's exact median, then 0.
    Medians are per entity, so every group is bounded by its periods."""
    d = fm.select("entity", "period", *[F.col(c).try_cast("double").alias(c) for c in cols],
                  *[c for c in ("stress",) if c in fm.columns])
    w = Window.partitionBy("entity")
    for c in cols:
        d = d.withColumn(c, F.coalesce(F.col(c), F.median(c).over(w), F.lit(0.0)))
    return d


def degenerate_label(df: DataFrame) -> Column:
    """M8: when the label has one class, use cogs_ratio > the entity's
    median cogs_ratio (per entity, like the imputation)."""
    return (F.col("cogs_ratio") > F.median("cogs_ratio").over(Window.partitionBy("entity"))).cast("int")


# ------------------------------------------------------------------ model zoo
def classifiers(n_trees: int = 200, gbt_iter: int = 100, xgb_iter: int = 120, seed: int = 42):
    """(name, factory(n_train) -> estimator, needs_scaling) in report order."""
    return [
        ("Logistic Regression",
         lambda n: LogisticRegression(featuresCol="zfeatures", labelCol="label", regParam=1.0 / max(n, 1),
                                      elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-8), True),
        ("Random Forest",
         lambda n: RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="w",
                                          numTrees=n_trees, maxDepth=3, seed=seed), False),
        ("Gradient Boosting",
         lambda n: GBTClassifier(featuresCol="features", labelCol="label", maxIter=gbt_iter, stepSize=0.1,
                                 maxDepth=3, seed=seed), False),
        ("XGBoost",
         lambda n: GBTClassifier(featuresCol="features", labelCol="label", maxIter=xgb_iter, stepSize=0.08,
                                 maxDepth=3, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed), False),
    ]


def _assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def _scale(train: DataFrame, apply_to: DataFrame, cols) -> DataFrame:
    """sklearn StandardScaler: population std, a zero std scales by 1.
    The statistics are one global aggregate over the training rows."""
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                      *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    z = [((F.col(c) - F.lit(stats[f"m_{c}"] or 0.0))
          / F.lit(stats[f"s_{c}"] if stats[f"s_{c}"] else 1.0)).alias(f"z_{c}") for c in cols]
    return _assemble(apply_to.select("*", *z), [f"z_{c}" for c in cols], "zfeatures")


def lab_table(fm: DataFrame, cols=FEATURE_COLS, folds: int = N_FOLDS) -> DataFrame:
    """Imputed features, label and fold id; cut from the feature-matrix
    lineage by a reliable checkpoint, before the first count, so that the
    feature matrix is computed once.  Vectors are assembled as rows are read:
    stored ones would double the table."""
    d = cut_lineage(impute_features(fm, cols))
    classes = d.select(F.count_distinct("stress").alias("k")).first()["k"]
    if classes > 1:
        d = d.withColumn("label", F.col("stress").cast("double"))
    else:
        d = cut_lineage(d.withColumn("label", degenerate_label(d).cast("double")))
    return _assemble(d.withColumn("fold", F.pmod(F.xxhash64("entity"), F.lit(folds)).cast("int")), cols)


def _class_stats(train: DataFrame):
    return train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"), F.avg("label").alias("rate")).first()


def _balanced(train: DataFrame, stats) -> DataFrame:
    """Balanced class weights n / (2 * n_class), from the rows that are trained on."""
    ones, zeros = stats["ones"], stats["n"] - stats["ones"]
    return train.withColumn("w", F.when(F.col("label") == 1, F.lit(stats["n"] / (2.0 * ones))).otherwise(
        F.lit(stats["n"] / (2.0 * zeros))))


def _proba(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("proba", vector_to_array("probability")[1])


def _fold_prediction(table: DataFrame, order: int, name: str, make, scaled: bool, f: int,
                     leaky_scaling: bool):
    train = table.where(F.col("fold") != f)
    test = table.where(F.col("fold") == f)
    stats = _class_stats(train)
    if stats["n"] == 0:
        return None
    if stats["ones"] in (0, stats["n"]):
        majority = float(stats["rate"] >= 0.5)
        pred = test.select("entity", "period", "label", F.lit(majority).alias("proba"))
    else:
        tr, te = train, test
        if scaled:
            base = table if leaky_scaling else train
            tr, te = _scale(base, train, FEATURE_COLS), _scale(base, test, FEATURE_COLS)
        model = make(stats["n"]).fit(_balanced(tr, stats))
        pred = _proba(model, te).select("entity", "period", "label", "proba")
    return pred.select(F.lit(order).alias("model_order"), F.lit(name).alias("model"), "entity",
                       "period", "label", "proba", F.lit(f).alias("fold"))


def cv_predictions(table: DataFrame, models=None, folds: int = N_FOLDS, leaky_scaling: bool = False,
                   parallelism: int = 4, errors: dict | None = None) -> DataFrame:
    """M5: out-of-fold probability for every row and model.  A fold whose
    training part has one class predicts that class (probability 0/1);
    prediction = probability >= 0.5.  Fits of different (model, fold) pairs
    are submitted from ``parallelism`` driver threads, like MLlib's
    ``CrossValidator(parallelism=...)``.  A model that fails in any fold is left
    out, and ``errors`` (if given) gets its place and message (M8); without
    ``errors`` the failure is raised."""
    from concurrent.futures import ThreadPoolExecutor
    models = models or classifiers()
    tasks = [(order, name, make, scaled, f) for order, (name, make, scaled) in enumerate(models)
             for f in range(folds)]

    def attempt(task):
        try:
            return _fold_prediction(table, *task, leaky_scaling)
        except Exception as e:  # any failure of a fit is that model's error row
            if errors is None:
                raise
            errors[task[1]] = (task[0], str(e).strip().splitlines()[0][:300])
            return None

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        parts = list(pool.map(attempt, tasks))
    kept = [p for p, t in zip(parts, tasks) if p is not None and t[1] not in (errors or {})]
    if not kept:
        kept = [table.limit(0).select(F.lit(0).alias("model_order"), F.lit("").alias("model"), "entity", "period", "label",
                                      F.lit(0.0).alias("proba"), F.lit(0).alias("fold"))]
    return reduce(DataFrame.unionByName, kept).withColumn("predicted", (F.col("proba") >= 0.5).cast("double"))


AUC_RANGES = 256


def _score_range(score: Column, bounds: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= score)) if bounds else F.lit(0)


def classification_metrics(pred: DataFrame, group_cols=("model_order", "model"), label: str = "label",
                           score: str = "proba", predicted: str = "predicted") -> DataFrame:
    """M6: accuracy, binary F1 (0 when undefined) and ROC-AUC by average
    ranks (NULL with one class).  Scores are reduced to (group, score) counts
    and cut into ranges at quantiles; ranks come from a prefix sum over the
    few ranges of a group and one inside each range, so no task holds all
    scores of a group."""
    g = list(group_cols)
    lab, pr = F.col(label).cast("int"), F.col(predicted).cast("int")
    conf = pred.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.sum((lab == pr).cast("long")).alias("correct"),
        F.sum(((lab == 1) & (pr == 1)).cast("long")).alias("tp"),
        F.sum(((lab == 0) & (pr == 1)).cast("long")).alias("fp"),
        F.sum(((lab == 1) & (pr == 0)).cast("long")).alias("fn"))
    by_score = pred.groupBy(*g, F.col(score).alias("s")).agg(
        F.sum((lab == 1).cast("long")).alias("pos"), F.sum((lab == 0).cast("long")).alias("neg"))
    cuts = pred.agg(F.percentile_approx(F.col(score).cast("double"), [i / AUC_RANGES for i in range(1, AUC_RANGES)], 10_000)
                    .alias("b")).first()["b"]
    by_score = by_score.withColumn("range", _score_range(F.col("s"), sorted(set(cuts or []))))
    before = Window.partitionBy(*g).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = by_score.groupBy(*g, "range").agg(F.sum("neg").alias("neg_range")).withColumn(
        "neg_before", F.coalesce(F.sum("neg_range").over(before), F.lit(0))).drop("neg_range")
    w = Window.partitionBy(*g, "range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    by_score = by_score.join(totals, [*g, "range"]).withColumn(
        "neg_below", F.col("neg_before") + F.coalesce(F.sum("neg").over(w), F.lit(0)))
    auc = by_score.groupBy(*g).agg(
        F.sum(F.col("pos") * (F.col("neg_below") * 2 + F.col("neg"))).alias("u2"),
        F.sum("pos").alias("npos"), F.sum("neg").alias("nneg"))
    auc = auc.select(*g, F.when((F.col("npos") > 0) & (F.col("nneg") > 0),
                                F.col("u2").cast("double") / (F.lit(2.0) * F.col("npos").cast("double")
                                                              * F.col("nneg").cast("double"))).alias("ROC_AUC"))
    f1_den = F.col("tp") * 2 + F.col("fp") + F.col("fn")
    m = conf.select(*g, (F.col("correct").cast("double") / F.col("n").cast("double")).alias("accuracy"),
                    F.when(f1_den > 0, (F.col("tp") * 2).cast("double") / f1_den.cast("double"))
                    .otherwise(F.lit(0.0)).alias("F1"))
    return m.join(auc, g, "left")


def comparison(metrics: DataFrame, errors: dict | None = None, folds: int = N_FOLDS) -> DataFrame:
    """M14 (classification part): the reference's comparison layout, with a
    row without scores for every model that failed (M8)."""
    label = f"Accuracy ({folds}-fold by entity)"
    rows = metrics.select(F.lit(CLASS_TASK).alias("task"), "model", F.lit(label).alias("metric_primary"),
                          F.col("accuracy").alias("score"), "F1", "ROC_AUC", "model_order", F.lit(None).cast("string").alias("error"))
    failed = [(CLASS_TASK, name, label, None, None, None, order, said) for name, (order, said) in (errors or {}).items()]
    return rows.unionByName(metrics.sparkSession.createDataFrame(
        failed, "task string, model string, metric_primary string, score double, F1 double, ROC_AUC double, model_order int, error string"))


def best_model(metrics: DataFrame) -> str:
    """M7: highest CV accuracy; on ties the later model wins."""
    row = metrics.select(F.max_by("model", F.struct("accuracy", "model_order")).alias("m")).first()
    return row["m"]


def refit(table: DataFrame, name: str, models=None):
    """Fit the chosen model on all rows; returns (model, scored table)."""
    models = models or classifiers()
    for _, (n, make, scaled) in enumerate(models):
        if n == name:
            data = _scale(table, table, FEATURE_COLS) if scaled else table
            stats = _class_stats(table)
            model = make(stats["n"]).fit(_balanced(data, stats))
            return model, _proba(model, data)
    raise KeyError(name)


def predictions(scored: DataFrame) -> DataFrame:
    """M9: entity, period, actual, probability, predicted."""
    return scored.select("entity", "period", F.col("label").cast("int").alias("actual_stress"),
                         F.col("proba").alias("predicted_stress_proba"),
                         (F.col("proba") >= 0.5).cast("int").alias("predicted_stress"))


def importance(model, cols=FEATURE_COLS, spark=None) -> DataFrame:
    """Impurity importance (trees) or |coefficient| (logistic), desc."""
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in model.coefficients.toArray().tolist()]
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    rows = sorted(((c, float(v)) for c, v in zip(cols, vals)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double").coalesce(1)


# ------------------------------------------------------------------ daily regression
def regressors(n_trees: int = 200, gbt_iter: int = 120, seed: int = 42):
    """(name, factory(n_train, sigma_y_pop) -> estimator) in report order."""
    return [
        ("Linear Regression", lambda n, s: LinearRegression(featuresCol="features", labelCol="total_sales",
                                                            regParam=0.0, solver="normal")),
        # sklearn Ridge(alpha=1) in MLlib's parametrisation (label is standardised internally).
        ("Ridge", lambda n, s: LinearRegression(featuresCol="features", labelCol="total_sales",
                                                regParam=1.0 * s / max(n, 1), elasticNetParam=0.0,
                                                standardization=False, solver="normal")),
        ("Random Forest Regressor", lambda n, s: RandomForestRegressor(
            featuresCol="features", labelCol="total_sales", numTrees=n_trees, maxDepth=4, seed=seed)),
        ("XGBoost Regressor", lambda n, s: GBTRegressor(featuresCol="features", labelCol="total_sales",
                                                        maxIter=gbt_iter, maxDepth=3, stepSize=0.08, seed=seed)),
    ]


def time_split(features: DataFrame, share: float = TRAIN_SHARE, min_rows: int = MIN_DAILY_ROWS) -> DataFrame:
    """M12 split: per entity, the first floor(share*n) days train, the rest
    test; entities with fewer than ``min_rows`` rows are left out."""
    w = Window.partitionBy("entity").orderBy("date")
    n = F.count(F.lit(1)).over(Window.partitionBy("entity"))
    d = features.withColumn("rn", F.row_number().over(w)).withColumn("n", n).where(F.col("n") >= min_rows)
    return d.withColumn("train", F.col("rn") <= F.floor(F.col("n") * F.lit(share)))


def regression_metrics(pred: DataFrame, group_cols=("model_order", "model"), y: str = "total_sales",
                       p: str = "prediction") -> DataFrame:
    """MAE, RMSE and R^2 = 1 - SSR/SST (NULL when SST = 0)."""
    g = list(group_cols)
    err = F.col(y) - F.col(p)
    m = pred.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("MAE"),
                             F.sqrt(F.avg(err * err)).alias("RMSE"), F.sum(err * err).alias("ssr"),
                             F.var_pop(y).alias("vy"))
    return m.select(*g, "n", "MAE", "RMSE",
                    F.when(F.col("vy") > 0, F.lit(1.0) - F.col("ssr") / (F.col("vy") * F.col("n"))).alias("R2"))


def lag1_regression_metrics(daily_feats: DataFrame) -> DataFrame:
    """M13 on the naive lag-1 forecast, per entity, from exact cents:
    MAE = sum|e|/n, RMSE = sqrt(sum e^2 / n), R^2 = 1 - n*SSR / (n*Syy - Sy^2)."""
    d = "decimal(38,0)"
    e = cents("total_sales") - cents("lag1")
    yv = cents("total_sales")
    g = daily_feats.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(e)).alias("sae"), F.sum(e.cast(d) * e.cast(d)).alias("sse"),
        F.sum(yv).alias("sy"), F.sum(yv.cast(d) * yv.cast(d)).alias("syy"))
    n = F.col("n")
    sst_n = (n.cast(d) * F.col("syy") - F.col("sy").cast(d) * F.col("sy").cast(d)).cast("double")
    sse = F.col("sse").cast("double")
    return g.select("entity", "n",
                    (F.col("sae").cast("double") / F.lit(100.0) / n.cast("double")).alias("MAE"),
                    F.sqrt(sse / F.lit(10000.0) / n.cast("double")).alias("RMSE"),
                    F.when(sst_n != 0, F.lit(1.0) - (sse * n.cast("double")) / sst_n).alias("R2"))


def daily_regression(features: DataFrame, models=None, errors: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Fit each regressor on the pooled training days, score the test
    days.  Returns (test predictions, metrics).  A model that fails is left out,
    and ``errors`` (if given) gets its place and message (M8); without ``errors``
    the failure is raised."""
    models = models or regressors()
    split = cut_lineage(_assemble(time_split(features), DAILY_FEATURE_COLS))
    train, test = split.where("train"), split.where("NOT train")
    st = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("total_sales").alias("s")).first()
    parts = []
    for order, (name, make) in enumerate(models):
        try:
            model = make(st["n"], st["s"] or 0.0).fit(train)
        except Exception as e:  # any failure of a fit is that model's error row
            if errors is None:
                raise
            errors[name] = (order, str(e).strip().splitlines()[0][:300])
            continue
        parts.append(model.transform(test).select(F.lit(order).alias("model_order"), F.lit(name).alias("model"),
                                                  "entity", "date", "total_sales", "prediction"))
    none = test.limit(0).select(F.lit(0).alias("model_order"), F.lit("").alias("model"), "entity", "date", "total_sales", F.lit(0.0).alias("prediction"))
    pred = reduce(DataFrame.unionByName, parts) if parts else none
    return pred, regression_metrics(pred)


REG_METRIC = "R2 (holdout)"


def full_comparison(class_metrics: DataFrame, reg_metrics: DataFrame, errors: dict | None = None, reg_errors: dict | None = None) -> DataFrame:
    """Classification and regression rows in one table, with a row for each model that failed (M8)."""
    c = comparison(class_metrics, errors)
    r = reg_metrics.select(F.lit(REG_TASK).alias("task"), "model", F.lit(REG_METRIC).alias("metric_primary"),
                           F.col("R2").alias("score"), F.lit(None).cast("double").alias("F1"),
                           F.lit(None).cast("double").alias("ROC_AUC"), (F.col("model_order") + 10).alias("model_order"),
                           F.lit(None).cast("string").alias("error"))
    failed = [(REG_TASK, name, REG_METRIC, None, None, None, order + 10, said) for name, (order, said) in (reg_errors or {}).items()]
    if failed:
        r = r.unionByName(class_metrics.sparkSession.createDataFrame(
            failed, "task string, model string, metric_primary string, score double, F1 double, ROC_AUC double, model_order int, error string"))
    return c.unionByName(r)
