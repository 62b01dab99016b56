"""Evaluation of a scored table.

Two aggregates carry everything:
* ``groupBy(label, prediction).count()`` gives the confusion matrix,
  accuracy, weighted precision/recall/F1 and balanced accuracy;
* ``groupBy(score)`` with positive/negative counts, then running sums in
  descending score order (range buckets, no single-task window), gives the
  exact AUC (Mann-Whitney, ties counted half), ROC and precision-recall.

Nothing is sorted or collected row by row; the per-score table is as large
as the number of distinct scores and stays distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running_sums
from ..session import cut_lineage


def score_counts(df: DataFrame, score: str = "score", label: str = "label", positive=1,
                 weight: str | None = None) -> DataFrame:
    """(score, pos, neg) per distinct non-null score (map-side combined); ``weight`` is the
    number of rows that a row stands for."""
    is_pos = F.col(label) == F.lit(positive)
    w = F.col(weight) if weight else F.lit(1)
    return (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(F.col(score).cast("double").alias("score"))
            .agg(F.sum(F.when(is_pos, w).otherwise(0)).cast("bigint").alias("pos"),
                 F.sum(F.when(is_pos, 0).otherwise(w)).cast("bigint").alias("neg")))


def written_counts(df: DataFrame, score: str = "score", label: str = "label", positive=1,
                   weight: str | None = None) -> DataFrame:
    """``score_counts`` and 1 for each score, written once: (score, pos, neg, one, _desc)."""
    return cut_lineage(score_counts(df, score, label, positive, weight).withColumns(
        {"one": F.lit(1).cast("bigint"), "_desc": -F.col("score")}), "score-counts")


def cumulative_counts(df: DataFrame, score: str = "score", label: str = "label", positive=1,
                      counts: DataFrame | None = None) -> DataFrame:
    """Per distinct score: pos, neg, tp = positives with score >= it, fp = negatives
    with score >= it, rank = its place in descending order, all from one running sum."""
    g = written_counts(df, score, label, positive) if counts is None else counts
    c = running_sums(g, ["_desc"], ["pos", "neg", "one"])
    return c.select("score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                    F.col("cum_one").alias("rank"))


def _totals(counts: DataFrame) -> tuple[int, int, int]:
    """(positives, negatives, distinct scores) of the written counts."""
    r = counts.agg(F.sum("pos"), F.sum("neg"), F.count(F.lit(1))).first()
    return int(r[0] or 0), int(r[1] or 0), int(r[2])


def auc_roc(df: DataFrame, score: str = "score", label: str = "label", positive=1,
            weight: str | None = None) -> DataFrame:
    """Exact area under ROC: P(score_pos > score_neg) + 0.5 P(equal).  One row."""
    cum = cumulative_counts(df, counts=written_counts(df, score, label, positive, weight))
    a = cum.agg(F.sum(F.col("neg").cast("double") * (F.col("tp") - 0.5 * F.col("pos"))).alias("_u"),
                F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return a.select(F.when((F.col("P") > 0) & (F.col("N") > 0),
                           F.col("_u") / F.col("P") / F.col("N")).alias("auc_roc"))


def auc_roc_by(df: DataFrame, by: list[str], score: str = "score", label: str = "label", positive=1) -> DataFrame:
    """``auc_roc`` of every group: (by..., auc_roc); the area is null where a class is
    missing.  ``by`` columns are non-null.  Counts by group and score are combined on the
    map side and all groups share one running sum, so a group of any size is spread."""
    is_pos = (F.col(label) == F.lit(positive)).cast("bigint")
    counts = (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
              .groupBy(*by, (-F.col(score)).alias("_desc"))
              .agg(F.sum(is_pos).alias("pos"), F.sum(1 - is_pos).alias("neg")))
    cum = running_sums(cut_lineage(counts, "score-counts-by"), ["_desc"], ["pos"], partition_cols=by)
    u = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - 0.5 * F.col("pos")))
    both = (F.sum("pos") > 0) & (F.sum("neg") > 0)
    return cum.groupBy(*by).agg(F.when(both, u / F.sum("pos") / F.sum("neg")).alias("auc_roc"))


def roc_curve(df: DataFrame, score: str = "score", label: str = "label", positive=1,
              bins: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr): one point per distinct score (predict positive when
    score >= threshold) plus the origin with a NULL threshold.  With ``bins``
    the distinct scores are cut into ``bins`` consecutive groups of equal size
    and each group keeps its last (lowest-score) point."""
    counts = written_counts(df, score, label, positive)
    P, N, n = _totals(counts)
    pts = cumulative_counts(df, score, label, positive, counts).select(
        F.col("score").alias("threshold"),
        (F.col("fp") / F.lit(N) if N else F.lit(None).cast("double")).alias("fpr"),
        (F.col("tp") / F.lit(P) if P else F.lit(None).cast("double")).alias("tpr"), "rank")
    if bins:
        grp = F.floor((F.col("rank") - 1) * F.lit(bins) / F.lit(max(n, 1)))
        last = pts.withColumn("_g", grp).groupBy("_g").agg(
            F.max_by(F.struct("threshold", "fpr", "tpr"), F.col("rank")).alias("p"))
        pts = last.select("p.threshold", "p.fpr", "p.tpr")
    else:
        pts = pts.drop("rank")
    origin = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                             F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts)


def pr_curve(df: DataFrame, score: str = "score", label: str = "label", positive=1) -> DataFrame:
    """(threshold, recall, precision) per distinct score."""
    counts = written_counts(df, score, label, positive)
    P, _, _ = _totals(counts)
    return cumulative_counts(df, score, label, positive, counts).select(F.col("score").alias("threshold"),
                      (F.col("tp") / F.lit(P) if P else F.lit(None).cast("double")).alias("recall"),
                      (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def curve_area(df: DataFrame, score: str = "score", label: str = "label", positive=1) -> DataFrame:
    """Trapezoid area under the ROC points of ``roc_curve`` (no lag window:
    each step's width and height come from the running sums of its row)."""
    cum = cumulative_counts(df, score, label, positive)
    a = cum.agg(F.sum(F.col("neg").cast("double") * (2.0 * F.col("tp") - F.col("pos"))).alias("_t"),
                F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return a.select(F.when((F.col("P") > 0) & (F.col("N") > 0),
                           F.col("_t") / 2.0 / F.col("P") / F.col("N")).alias("area"))


# ---------------------------------------------------------------- E2-E4 E6
def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     weight: str | None = None) -> DataFrame:
    """Long form (label, prediction, count); rows = actual, columns = predicted.  Rows
    without a label are left out, here and in all metrics."""
    return (df.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("double").alias("label"),
                       F.col(prediction).cast("double").alias("prediction"))
            .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("count")))


def confusion_matrix_wide(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          classes=(0.0, 1.0)) -> DataFrame:
    """One row per actual class, one column ``pred_<k>`` per predicted class."""
    cm = confusion_matrix(df, label, prediction)
    return cm.groupBy("label").agg(
        *[F.coalesce(F.sum(F.when(F.col("prediction") == float(k), F.col("count"))), F.lit(0))
          .cast("bigint").alias(f"pred_{int(k)}") for k in classes])


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                           weight: str | None = None) -> DataFrame:
    """One row: n, accuracy, weighted precision / recall / F1 (weights = true
    class share, MulticlassMetrics semantics), balanced accuracy (mean recall)."""
    cm = confusion_matrix(df, label, prediction, weight)
    actual = cm.groupBy("label").agg(F.sum("count").alias("actual"),
                                     F.sum(F.when(F.col("label") == F.col("prediction"), F.col("count"))
                                           .otherwise(0)).alias("tp"))
    pred = cm.groupBy(F.col("prediction").alias("label")).agg(F.sum("count").alias("predicted"))
    per = actual.join(pred, "label", "left").fillna(0, ["predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.col("tp") / F.col("actual")
    per = per.select("actual", "tp", prec.alias("p"), rec.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))) \
          .otherwise(0.0)
    a = per.agg(F.sum("actual").alias("n"), F.sum("tp").alias("tp"),
                F.sum(F.col("actual") * F.col("p")).alias("_wp"),
                F.sum(F.col("actual") * F.col("r")).alias("_wr"),
                F.sum(F.col("actual") * f1).alias("_wf"),
                F.avg("r").alias("balanced_accuracy"))
    return a.select(F.col("n").cast("bigint").alias("n"),
                    (F.col("tp") / F.col("n")).alias("accuracy"),
                    (F.col("_wp") / F.col("n")).alias("weighted_precision"),
                    (F.col("_wr") / F.col("n")).alias("weighted_recall"),
                    (F.col("_wf") / F.col("n")).alias("weighted_f1"),
                    "balanced_accuracy")


def balanced_accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(TPR + TNR) / 2 for a binary label: the number the reference reports as
    'AUC' when it passes hard predictions as the score."""
    return classification_metrics(df, label, prediction).select("balanced_accuracy")
