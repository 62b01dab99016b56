"""Classifiers, scoring and model introspection.

Spark ML does the fitting (tree aggregation on the executors); this module
only fixes the kinds, their defaults, seeds, and turns fitted parameters
(small, bounded by the feature count) into DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression, NaiveBayes,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

KINDS = {
    "random_forest": RandomForestClassifier,
    "logistic_regression": LogisticRegression,
    "decision_tree": DecisionTreeClassifier,
    "naive_bayes": NaiveBayes,
}
# The reference's model settings (forest and tree use library defaults).
DEFAULTS = {
    "random_forest": {},
    "logistic_regression": {"elasticNetParam": 0.5, "regParam": 0.1},
    "decision_tree": {},
    "naive_bayes": {},
}
_SEEDED = {"random_forest", "decision_tree"}


def make_estimator(kind: str, label: str = "label", features_col: str = "features", seed: int = 0,
                   **params):
    if kind not in KINDS:
        raise ValueError(f"unknown model kind {kind!r}; one of {sorted(KINDS)}")
    args = dict(DEFAULTS[kind])
    args.update(params)
    if kind in _SEEDED:
        args.setdefault("seed", seed)
    return KINDS[kind](featuresCol=features_col, labelCol=label, **args)


def assemble_classifier(kind: str, features: Sequence[str], label: str, seed: int = 0, **params) -> Pipeline:
    """Pipeline [VectorAssembler, classifier]; the label is never a feature."""
    if label in features:
        raise ValueError(f"label {label!r} must not be a feature")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return Pipeline(stages=[assembler, make_estimator(kind, label, "features", seed, **params)])


def train_model(kind: str, df: DataFrame, features: Sequence[str], label: str, seed: int = 0,
                **params) -> PipelineModel:
    lab = df.withColumn(label, F.col(label).cast("double"))
    return assemble_classifier(kind, features, label, seed, **params).fit(lab)


def score(model, df: DataFrame, label: str, keep: Sequence[str] = (), flat: bool = True,
          order_by: str | None = None) -> DataFrame:
    """Apply a fitted model.  ``flat``: (keep..., label, prediction, score) where
    score = probability of class 1 (vector_to_array, no Python).  ``order_by``
    sorts the result (the reference sorts by prediction; no metric needs it)."""
    out = model.transform(df.withColumn(label, F.col(label).cast("double")))
    if flat:
        out = out.select(*keep, F.col(label).alias("label"), "prediction",
                         vector_to_array("probability")[1].alias("score"))
    return out.orderBy(order_by) if order_by else out


def _classifier(model):
    """The classifier inside a fitted pipeline or a cross-validated one."""
    if isinstance(model, CrossValidatorModel):
        model = model.bestModel
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def feature_importances(model, names: Sequence[str]) -> DataFrame:
    """(feature, importance) of a tree model."""
    from pyspark.sql import SparkSession
    m = _classifier(model)
    imp = m.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(list(zip(names, [float(v) for v in imp])), "feature string, importance double")


def coefficients(model, names: Sequence[str]) -> DataFrame:
    """(feature, coefficient) of a logistic regression; the intercept as '(intercept)'."""
    from pyspark.sql import SparkSession
    m = _classifier(model)
    rows = [(n, float(c)) for n, c in zip(names, m.coefficients.toArray().tolist())]
    rows.append(("(intercept)", float(m.intercept)))
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, coefficient double")


def objective_history(model) -> DataFrame:
    from pyspark.sql import SparkSession
    m = _classifier(model)
    hist = m.summary.objectiveHistory
    return SparkSession.getActiveSession().createDataFrame(
        [(i, float(v)) for i, v in enumerate(hist)], "iteration int, objective double")


def explain_params(model) -> DataFrame:
    """(param, value, doc) of the classifier's parameters."""
    from pyspark.sql import SparkSession
    m = _classifier(model)
    rows = []
    for p, v in sorted(m.extractParamMap().items(), key=lambda kv: kv[0].name):
        rows.append((p.name, str(v), p.doc))
    return SparkSession.getActiveSession().createDataFrame(rows, "param string, value string, doc string")


# ---------------------------------------------------------------- M5 closed form
def naive_bayes_stats(df: DataFrame, features: Sequence[str], label: str, smoothing: float = 1.0) -> DataFrame:
    """Multinomial naive Bayes parameters in one aggregate:
    prior  = ln(n_c + a) - ln(N + C a)
    theta  = ln(S_cj + a) - ln(S_c + d a),  S_cj = sum of feature j in class c.
    Output (label, term, log_prob) with term '(prior)' for the prior."""
    features = list(features)
    a = float(smoothing)
    g = df.groupBy(F.col(label).cast("double").alias("label")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(f).cast("double")).alias(f) for f in features])
    g = cut_lineage(g, "bayes-classes")     # one row for each class
    tot = g.agg(F.sum("_n").alias("N"), F.count(F.lit(1)).alias("C")).first()
    g = g.select("*", F.lit(tot["N"] or 0).alias("N"), F.lit(tot["C"]).alias("C"))
    s_c = sum((F.col(f) for f in features[1:]), F.col(features[0]))
    d = len(features)
    items = [F.struct(F.lit("(prior)").alias("term"),
                      (F.log(F.col("_n") + a) - F.log(F.col("N") + F.col("C") * a)).alias("log_prob"))]
    items += [F.struct(F.lit(f).alias("term"),
                       (F.log(F.col(f) + a) - F.log(s_c + d * a)).alias("log_prob")) for f in features]
    return g.select("label", F.explode(F.array(*items)).alias("e")).select("label", "e.term", "e.log_prob")
