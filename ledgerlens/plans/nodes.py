"""Fitted models as tables, and scorers that read the tables.

``node_table`` turns a fitted tree or forest into one row per node, ``models.coefficients`` a
logistic regression into one row per term.  Any engine can score from these tables by a
join or a walk; ``score_nodes`` and ``score_linear`` do it here, without Spark ML's models: a
logistic regression is a plain column expression; trees are flat numpy arrays walked level
by level in Arrow batches, all rows at once.

The depth sweep of a decision tree needs one fit.  A split depends only on the rows that
reach its node, so the tree fitted to depth d is the first d levels of a deeper one (the
joining of leaves that predict the same changes no prediction).  One pass over the rows walks
each to its leaf, notes the prediction of every node on the way, and counts the right ones
by depth; a fit and two scorings for each depth are not needed.  A forest draws its features
in the order in which it grows nodes, which depends on the depth, so its sweep is fitted.

The node arrays reach the driver and go to the tasks, as a fitted model does; they are
bounded by trees x 2^(depth + 1).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .models import _classifier, assemble_classifier


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def node_table(model, names: Sequence[str]) -> DataFrame:
    """(tree, node, feature, threshold, left, right, prediction, gain, stats) of a fitted
    decision tree or random forest, also inside a pipeline or a tuned model.  A row goes left
    if its feature is at most the threshold; leaves have no feature.  ``stats`` holds the
    weight of each class at the node."""
    m = _classifier(model)
    if not hasattr(m, "featureImportances"):
        raise ValueError(f"{type(m).__name__} has no nodes")
    spark = SparkSession.getActiveSession()
    path = scratch_dir(spark, "model-nodes")
    m.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select(F.col("treeID").cast("int").alias("tree"), "nodeData.*")
    else:
        data = data.withColumn("tree", F.lit(0))
    inner = F.col("leftChild") >= 0
    if data.filter(inner & (F.col("split.numCategories") > -1)).limit(1).count():
        raise ValueError("a split on a categorical feature has no threshold")
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("split.featureIndex") + 1)
    return data.select(
        "tree", F.col("id").cast("int").alias("node"), F.when(inner, label).alias("feature"),
        F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(inner, F.col("leftChild")).cast("int").alias("left"), F.when(inner, F.col("rightChild")).cast("int").alias("right"),
        "prediction", F.when(inner, F.col("gain")).alias("gain"), F.col("impurityStats").alias("stats"))


class Trees:
    """The nodes of all trees in flat arrays."""

    def __init__(self, rows: Sequence, features: Sequence[str]):
        rows = sorted(rows, key=lambda r: (r["tree"], r["node"]))
        place = {(r["tree"], r["node"]): i for i, r in enumerate(rows)}
        number = {f: i for i, f in enumerate(features)}
        unknown = {r["feature"] for r in rows if r["feature"] is not None} - set(number)
        if unknown:
            raise ValueError(f"the table lacks the model's features {sorted(unknown)}")
        leaf = np.array([r["feature"] is None for r in rows])
        self.leaf = leaf
        self.feature = np.array([0 if r["feature"] is None else number[r["feature"]] for r in rows])
        self.threshold = np.array([0.0 if r["threshold"] is None else r["threshold"] for r in rows])
        self.left = np.array([i if r["left"] is None else place[r["tree"], r["left"]] for i, r in enumerate(rows)])
        self.right = np.array([i if r["right"] is None else place[r["tree"], r["right"]] for i, r in enumerate(rows)])
        self.prediction = np.array([float(r["prediction"]) for r in rows])
        stats = np.array([list(r["stats"]) for r in rows], dtype=np.float64)
        self.share = stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300)
        self.roots = [place[t, 0] for t in sorted({r["tree"] for r in rows})]

    def walk(self, x: np.ndarray, root: int) -> Iterator[np.ndarray]:
        """The node of each row at depth 0, 1, ... until all rows are at leaves."""
        node = np.full(len(x), root)
        rows = np.arange(len(x))
        while True:
            yield node
            if self.leaf[node].all():
                return
            left = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(left, self.left[node], self.right[node])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes): the mean over the trees of the leaves' class shares."""
        total = np.zeros((len(x), self.share.shape[1]))
        for root in self.roots:
            for node in self.walk(x, root):
                pass
            total += self.share[node]
        return total / len(self.roots)


def _matrix(part: pa.RecordBatch, column: str) -> np.ndarray:
    return part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _vector(features: Sequence[str]) -> Column:
    """The features as doubles; a missing value raises, as the assembler does."""
    def checked(f: str) -> Column:
        v = _quoted(f).cast("double")
        return F.when(v.isNull() | F.isnan(v), F.raise_error(F.lit(f"missing value in feature {f}")).cast("double")).otherwise(v)
    return F.array(*[checked(f) for f in features])


def score_nodes(df: DataFrame, nodes: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., label, prediction, score) like ``models.score``, from a node table."""
    trees = Trees(nodes.collect(), features)      # one row per node of the model
    narrow = df.select(*[_quoted(c).alias(c) for c in keep], _quoted(label).cast("double").alias("label"),
                       _vector(features).alias("_x"))
    names = [*narrow.columns[:-1], "prediction", "score"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            p = trees.probabilities(_matrix(part, "_x"))
            kept = [part.column(i) for i in range(part.num_columns - 1)]
            score = p[:, 1] if p.shape[1] > 1 else np.zeros(len(p))
            yield pa.record_batch([*kept, pa.array(p.argmax(axis=1).astype(np.float64)), pa.array(score)],
                                  names=names)

    from pyspark.sql.types import DoubleType, StructType
    schema = StructType(narrow.schema.fields[:-1]).add("prediction", DoubleType()).add("score", DoubleType())
    return narrow.mapInArrow(run, schema)


def score_linear(df: DataFrame, coefficients: DataFrame, label: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., label, prediction, score) of a logistic regression's (feature, coefficient)
    table; one column expression, no Python worker."""
    terms = {r["feature"]: float(r["coefficient"]) for r in coefficients.collect()}     # one row per feature
    odds = F.lit(terms.pop("(intercept)", 0.0))
    for f, w in terms.items():
        odds = odds + _quoted(f).cast("double") * F.lit(w)
    score = 1 / (1 + F.exp(-odds))
    return df.select(*[_quoted(c).alias(c) for c in keep], _quoted(label).cast("double").alias("label"),
                     (score > 0.5).cast("double").alias("prediction"), score.alias("score"))


def importances(nodes: DataFrame) -> DataFrame:
    """(feature, importance) from a node table: each tree's gains weighted by the rows at the
    node, shares of the tree's total, averaged over the trees.  Features that no tree splits
    on are absent."""
    rows = F.aggregate("stats", F.lit(0.0), lambda a, x: a + x)
    by_tree = nodes.filter(F.col("feature").isNotNull()).groupBy("tree", "feature").agg(
        F.sum(F.col("gain") * rows).alias("gain"))
    total = by_tree.groupBy("tree").agg(F.sum("gain").alias("total"))
    shares = by_tree.join(total, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("total")).alias("share"))
    whole = by_tree.select("tree").distinct().count()      # each tree's shares add up to 1
    return shares.select("feature", (F.col("share") / F.lit(float(whole or 1))).alias("importance"))


def depth_sweep(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, depths: Sequence[int],
                seed: int = 0, **fixed) -> DataFrame:
    """(value, train_accuracy, test_accuracy) of a decision tree at each depth, from one fit."""
    depths = [int(v) for v in depths]
    model = assemble_classifier("decision_tree", features, label, seed, maxDepth=max(depths), **fixed).fit(
        train.withColumn(label, F.col(label).cast("double")))
    trees = Trees(node_table(model, features).collect(), features)
    side = lambda df, n: df.select(F.lit(n).alias("side"), _quoted(label).cast("double").alias("label"),
                                   _vector(features).alias("x"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            sides, y, x = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False), _matrix(part, "x")
            known = ~np.isnan(y)
            path = [trees.prediction[node] for node in trees.walk(x, trees.roots[0])]
            rows = [(int(s), d, int(known[sides == s].sum()),
                     int((path[min(d, len(path) - 1)] == y)[sides == s].sum())) for s in np.unique(sides) for d in depths]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["side", "depth", "n", "good"])

    counts = side(train, 0).unionByName(side(test, 1)).mapInArrow(run, "side bigint, depth bigint, n bigint, good bigint")
    share = lambda s: F.try_divide(F.sum(F.when(F.col("side") == s, F.col("good"))),
                                   F.sum(F.when(F.col("side") == s, F.col("n"))))
    return counts.groupBy(F.col("depth").cast("double").alias("value")).agg(
        share(0).alias("train_accuracy"), share(1).alias("test_accuracy"))
