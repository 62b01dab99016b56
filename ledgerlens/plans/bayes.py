"""Tuning and sweeping naive Bayes from sufficient statistics.

The parameters of multinomial naive Bayes are functions of row counts and feature sums by
class.  One aggregate by (fold, class) gives them for the whole table; what a fold's
training side has is the total less the fold, for every smoothing value, so no grid point
and no fold is fitted again.  One more pass over the rows scores each held-out row with
all smoothing values at once (feature by feature from the left, so equal rows get equal
scores); only counts by (value, fold, score) are shuffled.

The score is the log odds of class 1, which orders rows as its probability does.  A
smoothing of 0 leaves features that a class never saw impossible there: a row that has
one of them is impossible in that class, its odds are infinite one way; a row impossible
in both classes, or in neither, is compared on the terms that are finite.

At most folds x 2 rows of sums reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import auc_roc_by
from ..operators.split import assign_folds
from ..session import cut_lineage


def class_sums(df: DataFrame, features: Sequence[str], label: str, by: str | None = None) -> dict[int, np.ndarray]:
    """``by`` value (0 if none) -> array (2, 1 + features): rows and feature sums of the
    classes 0 and 1.  Raises on labels that are neither, on missing and on negative values."""
    features = list(features)
    group = F.col(by).cast("int").alias("_by") if by else F.lit(0).alias("_by")
    x = [F.col(f"`{f}`").cast("double") for f in features]
    bad = [F.sum((c.isNull() | F.isnan(c) | (c < 0)).cast("int")).alias(f"b{i}") for i, c in enumerate(x)]
    rows = df.groupBy(group, F.col(f"`{label}`").cast("double").alias("_label")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *bad).collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        if r["_label"] not in (0.0, 1.0):
            raise ValueError(f"naive Bayes tuning needs labels 0 and 1, found {r['_label']!r}")
        wrong = [f for i, f in enumerate(features) if r[f"b{i}"]]
        if wrong:
            raise ValueError(f"missing or negative values in features {wrong}")
        own = out.setdefault(int(r["_by"]), np.zeros((2, 1 + len(features))))
        own[int(r["_label"])] = [float(r["n"]), *[float(r[f"s{i}"]) for i in range(len(features))]]
    return out


def log_parameters(sums: np.ndarray, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """(priors of both classes, theta (2, features)); -inf where a probability is 0."""
    a, d = float(smoothing), sums.shape[1] - 1
    present = int((sums[:, 0] > 0).sum())
    prior, theta = np.full(2, -math.inf), np.full((2, d), -math.inf)
    for c in range(2):
        if sums[c, 0] > 0 or (a > 0 and present == 2):
            prior[c] = math.log(sums[c, 0] + a) - math.log(sums[:, 0].sum() + present * a)
        total = sums[c, 1:].sum() + d * a
        for j in range(d):
            if sums[c, 1 + j] + a > 0:
                theta[c, j] = math.log(sums[c, 1 + j] + a) - math.log(total)
    return prior, theta


class Scorer:
    """Log odds of class 1 for rows of features, for several parameter sets at once."""

    def __init__(self, parameters: Sequence[tuple[np.ndarray, np.ndarray]]):
        prior = np.stack([p for p, _ in parameters], axis=1)          # (2, sets)
        theta = np.stack([t for _, t in parameters], axis=2)          # (2, features, sets)
        self.no_class = np.isneginf(prior)
        self.impossible = np.isneginf(theta)
        self.prior = np.where(self.no_class, 0.0, prior)
        self.theta = np.where(self.impossible, 0.0, theta)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raw = np.repeat(self.prior[:, None, :], len(x), axis=1)       # (2, rows, sets)
        out = np.repeat(self.no_class[:, None, :], len(x), axis=1)
        for j in range(x.shape[1]):
            raw += x[None, :, j, None] * self.theta[:, None, j, :]
            if self.impossible[:, j].any():
                out |= (x[None, :, j, None] > 0) & self.impossible[:, None, j, :]
        odds = raw[1] - raw[0]
        odds[out[1] & ~out[0]] = -math.inf
        odds[out[0] & ~out[1]] = math.inf
        return odds


def _scored(df: DataFrame, features: Sequence[str], label: str, group: str, scorers: dict[int, Scorer], n_sets: int) -> DataFrame:
    """(group, label, odds array): each row scored with the parameter sets of its group."""
    narrow = df.select(F.col(group).cast("int").alias("group"), F.col(f"`{label}`").cast("double").alias("label"),
                       F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("x"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            groups = part.column(0).to_numpy()
            odds = np.empty((len(x), n_sets))
            for g in np.unique(groups).tolist():
                odds[groups == g] = scorers[g](x[groups == g])
            flat = pa.array(odds.ravel())
            at = pa.array(np.arange(0, odds.size + 1, n_sets), pa.int32())
            yield pa.record_batch([part.column(0), part.column(1), pa.ListArray.from_arrays(at, flat)],
                                  names=["group", "label", "odds"])

    return narrow.mapInArrow(run, "group int, label double, odds array<double>")


def fold_metrics(df: DataFrame, features: Sequence[str], label: str, key: str, smoothings: Sequence[float],
                 folds: int = 3, seed: int = 0) -> DataFrame:
    """(smoothing, fold, auc_roc): each value's area under ROC on each held-out fold; null
    where a fold lacks a class."""
    values = [float(v) for v in dict.fromkeys(smoothings)]
    data = assign_folds(df.select(key, *features, label), key, folds, seed, "fold")
    sums = class_sums(data, features, label, "fold")
    total = sum(sums.values(), np.zeros((2, 1 + len(features))))
    scorers = {f: Scorer([log_parameters(total - s, v) for v in values]) for f, s in sums.items()}
    scored = _scored(data, features, label, "fold", scorers, len(values))
    long = scored.select(F.col("group").alias("fold"), "label", F.posexplode("odds").alias("value", "score"))
    auc = auc_roc_by(long, ["value", "fold"], "score", "label")
    named = df.sparkSession.createDataFrame([(i, v, f) for i, v in enumerate(values) for f in range(folds)],
                                            "value int, smoothing double, fold int")
    # one row for each value and fold on both sides
    return cut_lineage(F.broadcast(named).join(auc, ["value", "fold"], "left").select("smoothing", "fold", "auc_roc"),
                       "bayes-folds")


def sweep(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, smoothings: Sequence[float]) -> DataFrame:
    """(value, train_accuracy, test_accuracy) of each smoothing value, from one aggregate of
    the training rows and one pass that scores both sides."""
    values = [float(v) for v in smoothings]
    sums = class_sums(train, features, label).get(0, np.zeros((2, 1 + len(features))))
    scorer = Scorer([log_parameters(sums, v) for v in values])
    both = train.select(*features, label).withColumn("_side", F.lit(0)).unionByName(
        test.select(*features, label).withColumn("_side", F.lit(1)))
    scored = _scored(both, features, label, "_side", {0: scorer, 1: scorer}, len(values))
    right = (F.col("odds") > 0).cast("double") == F.col("label")
    acc = scored.select("group", "label", F.posexplode("odds").alias("value", "odds")).groupBy("value").agg(
        *[F.avg(F.when(F.col("group") == g, right.cast("double"))).alias(a)
          for g, a in ((0, "train_accuracy"), (1, "test_accuracy"))])
    named = train.sparkSession.createDataFrame(list(enumerate(values)), "i int, v double")
    return F.broadcast(named).join(acc, F.col("i") == F.col("value"), "left").select(
        F.col("v").alias("value"), "train_accuracy", "test_accuracy")
