"""Model comparison and selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import evaluate

METRICS = ["accuracy", "precision", "recall", "auc_roc"]


def model_metrics(name: str, scored: DataFrame, label: str = "label", prediction: str = "prediction",
                  score: str = "score") -> DataFrame:
    """One row (name_model, accuracy, precision, recall, auc_roc).  The scored rows are read
    once: both metrics come from their counts by (label, prediction, score), written once."""
    grouped = cut_lineage(scored.groupBy(
        F.col(label).alias("label"), F.col(prediction).alias("prediction"), F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("rows")), "scored-counts")
    auc = evaluate.auc_roc(grouped, weight="rows").first()["auc_roc"]
    return evaluate.classification_metrics(grouped, weight="rows").select(
        F.lit(name).alias("name_model"), "accuracy",
        F.col("weighted_precision").alias("precision"),
        F.col("weighted_recall").alias("recall"), F.lit(auc).cast("double").alias("auc_roc"))


def compare_models(results: Mapping[str, DataFrame], label: str = "label", prediction: str = "prediction",
                   score: str = "score", transpose: bool = False) -> DataFrame:
    """One row per model; with ``transpose`` one row per metric and one column per model."""
    frames = [model_metrics(n, df, label, prediction, score) for n, df in results.items()]
    table = frames[0]
    for f in frames[1:]:
        table = table.unionByName(f)
    if not transpose:
        return table
    return transpose_metrics(table, list(results))


def transpose_metrics(table: DataFrame, names: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    long = table.select("name_model", F.explode(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    )).alias("m")).select("name_model", "m.metric", "m.value")
    return long.groupBy("metric").pivot("name_model", list(names)).agg(F.first("value"))


def select_model(table: DataFrame, metric: str = "auc_roc", gap_col: str | None = None,
                 max_gap: float | None = None) -> DataFrame:
    """Best row by ``metric`` (ties by name); rows whose train-test gap exceeds
    ``max_gap`` are excluded first (the reference's 'without overfitting')."""
    if gap_col and max_gap is not None:
        table = table.filter(F.col(gap_col) <= max_gap)
    return table.orderBy(F.col(metric).desc_nulls_last(), F.col("name_model")).limit(1)
