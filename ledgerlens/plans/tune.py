"""Grids, cross-validation and overfitting sweeps.

Folds come from the key hash (``assign_folds``), so a tuning run is
reproducible and independent of partitioning; the rows are written once,
partitioned by fold, and the repeated fits scan the folds they need.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.split import assign_folds
from ..session import scratch_dir
from ..sources import files
from . import bayes, nodes
from .models import assemble_classifier, score

# The reference's grids (the LR grid as intended: 0, 0.5, 1).
GRIDS = {
    "random_forest": {"numTrees": [10, 20, 30], "maxDepth": [5, 12, 20]},
    "logistic_regression": {"regParam": [0.0, 0.5, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
    "decision_tree": {"impurity": ["gini", "entropy"]},
    "naive_bayes": {"smoothing": [0.0, 2.0, 5.0]},
}
# The reference's overfitting sweeps.
SWEEPS = {
    "random_forest": ("maxDepth", list(range(0, 11))),
    "logistic_regression": ("elasticNetParam", [round(0.1 * i, 1) for i in range(11)]),
    "decision_tree": ("maxDepth", list(range(1, 16))),
    "naive_bayes": ("smoothing", list(range(0, 11))),
}


def default_grid(kind: str, estimator, grid: dict | None = None):
    spec = grid or GRIDS[kind]
    b = ParamGridBuilder()
    for name, values in spec.items():
        b = b.addGrid(estimator.getParam(name), list(dict.fromkeys(values)))
    return b.build()


def _by_fold(df: DataFrame, features: Sequence[str], label: str, key: str, folds: int, seed: int) -> DataFrame:
    """The rows written once, one folder for each fold: a fold's training and held-out scans
    read their folders only, and a lost executor reads them again instead of computing them."""
    data = assign_folds(df.select(key, *features, label), key, folds, seed, "fold").withColumn(label, F.col(label).cast("double"))
    path = files.write_prepared(data, scratch_dir(df.sparkSession, "tuning-folds"), partition_by=["fold"])
    return files.read_table(df.sparkSession, path)


def tune(kind: str, df: DataFrame, features: Sequence[str], label: str, key: str, folds: int = 3,
         grid: dict | None = None, seed: int = 0, parallelism: int = 2):
    """Cross-validation on ``folds`` hash folds, maximising the exact area under ROC
    (``numBins=0``) on ``rawPrediction``; naive Bayes over ``smoothing`` comes from sums by
    fold and one scoring pass (``bayes.fold_metrics``) and fits only the best value.
    Returns (CrossValidatorModel, DataFrame of grid point x mean metric)."""
    if kind == "naive_bayes" and set(grid or GRIDS[kind]) == {"smoothing"}:
        return _tune_bayes(df, features, label, key, folds, (grid or GRIDS[kind])["smoothing"], seed)
    data = _by_fold(df, features, label, key, folds, seed)
    pipe = assemble_classifier(kind, features, label, seed)
    maps = default_grid(kind, pipe.getStages()[-1], grid)
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction",
                                       metricName="areaUnderROC", numBins=0)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=ev, foldCol="fold", numFolds=folds,
                        parallelism=parallelism, seed=seed)
    model = cv.fit(data)
    rows = []
    for pm, metric in zip(maps, model.avgMetrics):
        rows.append((_params_text(pm), float(metric)))
    table = df.sparkSession.createDataFrame(rows, "params string, auc_roc double")
    return model, table


def _smoothing_text():
    return F.concat(F.lit("smoothing="), F.col("smoothing").cast("string")).alias("params")


def _tune_bayes(df: DataFrame, features: Sequence[str], label: str, key: str, folds: int, smoothings: Sequence, seed: int):
    """The mean is over the folds that hold both classes."""
    values = [float(v) for v in dict.fromkeys(smoothings)]
    means = bayes.fold_metrics(df, features, label, key, values, folds, seed).groupBy("smoothing").agg(
        F.avg("auc_roc").alias("auc_roc"))
    found = {r["smoothing"]: r["auc_roc"] for r in means.collect()}      # one row for each value
    metrics = [math.nan if found.get(v) is None else float(found[v]) for v in values]
    best = max(range(len(values)), key=lambda i: (not math.isnan(metrics[i]), metrics[i]))
    pipe = assemble_classifier("naive_bayes", features, label, seed)
    maps = default_grid("naive_bayes", pipe.getStages()[-1], {"smoothing": values})
    fitted = pipe.fit(df.withColumn(label, F.col(label).cast("double")), maps[best])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, numFolds=folds, seed=seed, foldCol="fold",
                        evaluator=BinaryClassificationEvaluator(labelCol=label, numBins=0))
    model = cv._copyValues(CrossValidatorModel(fitted, metrics))
    return model, means.select(_smoothing_text(), "auc_roc")


def fold_metrics(kind: str, df: DataFrame, features: Sequence[str], label: str, key: str, folds: int = 3,
                 grid: dict | None = None, seed: int = 0) -> DataFrame:
    """(params, fold, auc_roc): each grid point's metric on each fold."""
    if kind == "naive_bayes" and set(grid or GRIDS[kind]) == {"smoothing"}:
        auc = bayes.fold_metrics(df, features, label, key, (grid or GRIDS[kind])["smoothing"], folds, seed)
        return auc.select(_smoothing_text(), "fold", "auc_roc")
    data = _by_fold(df, features, label, key, folds, seed)
    rows = []
    pipe = assemble_classifier(kind, features, label, seed)
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction",
                                       metricName="areaUnderROC", numBins=0)
    maps = default_grid(kind, pipe.getStages()[-1], grid)
    for fold in range(folds):
        train, test = data.filter(F.col("fold") != fold), data.filter(F.col("fold") == fold)
        for i, model in pipe.fitMultiple(train, maps):
            rows.append((_params_text(maps[i]), fold, float(ev.evaluate(model.transform(test)))))
    return df.sparkSession.createDataFrame(rows, "params string, fold int, auc_roc double")


def _params_text(params: dict) -> str:
    return ", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda kv: kv[0].name))


def best_params(cv_model) -> DataFrame:
    """(param, value) of the best point of the grid that was tuned."""
    maps, metrics = cv_model.getEstimatorParamMaps(), cv_model.avgMetrics
    best = maps[max(range(len(maps)), key=lambda i: metrics[i])]
    rows = sorted((p.name, str(v)) for p, v in best.items())
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession().createDataFrame(rows, "param string, value string")


def sweep(kind: str, train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
          param: str | None = None, values: Sequence | None = None, seed: int = 0, **fixed) -> DataFrame:
    """(value, train_accuracy, test_accuracy) for one hyperparameter over a list.
    The LR sweep keeps regParam = 0.1 so that elasticNetParam has an effect.  Smoothing
    comes from one aggregate (``bayes.sweep``), the depth of a tree from one fit at the
    greatest depth (``nodes.depth_sweep``); other parameters are fitted value by value."""
    if param is None:
        param, values = SWEEPS[kind]
    if kind == "naive_bayes" and param == "smoothing" and not fixed:
        return bayes.sweep(train, test, features, label, values)
    if kind == "decision_tree" and param == "maxDepth":
        return nodes.depth_sweep(train, test, features, label, values, seed, **fixed)
    if kind == "logistic_regression":
        fixed.setdefault("regParam", 0.1)
    tr = train.withColumn(label, F.col(label).cast("double")).persist(StorageLevel.MEMORY_AND_DISK)
    te = test.withColumn(label, F.col(label).cast("double")).persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    try:
        for v in values:
            model = assemble_classifier(kind, features, label, seed, **{param: v, **fixed}).fit(tr)
            accs = []
            for part in (tr, te):
                s = score(model, part, label)
                accs.append(s.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
            rows.append((float(v), float(accs[0]), float(accs[1])))
    finally:
        tr.unpersist()
        te.unpersist()
    return train.sparkSession.createDataFrame(rows, "value double, train_accuracy double, test_accuracy double")
