"""Losses and limits that must not come back."""

import math
import os
from types import SimpleNamespace

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens import session
from ledgerlens.operators import balance, evaluate, explore, features, profile, split
from ledgerlens.plans import flow, models, tune
from ledgerlens.sources import files


def test_scratch_tables_go_with_their_scope(spark):
    with session.scratch_scope(spark):
        df = session.cut_lineage(spark.range(10).toDF("x"), "scoped")
        folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.isdir(folder) and explore.box_stats(df, ["x"]).count() == 1
        made = list(session._SCOPES[-1])
    assert len(made) > 1 and not any(os.path.exists(p.removeprefix("file://")) for p in made)


def test_a_cluster_needs_a_shared_folder():
    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077"))
    cluster.conf = SimpleNamespace(get=lambda k, d=None: d)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(cluster)
    cluster.conf = SimpleNamespace(get=lambda k, d=None: "hdfs://nn/tmp/")
    assert session.scratch_dir(cluster, "x").startswith("hdfs://nn/tmp/x-")


def test_auc_of_counts_beyond_bigint_products(spark):
    rows = [(1, 0.9, 10**9), (0, 0.1, 10**12), (1, 0.1, 10**9)]
    df = spark.createDataFrame(rows, "label int, score double, w bigint")
    assert math.isclose(evaluate.auc_roc(df, weight="w").first()[0], 0.75)


def test_rows_without_a_label_are_in_no_class(spark):
    df = spark.createDataFrame([(1, 1.0, 0.9), (0, 0.0, 0.1), (None, 1.0, 0.8), (None, 0.0, 0.3)],
                               "label int, prediction double, score double")
    m = evaluate.classification_metrics(df).first()
    assert m["n"] == 2 and m["accuracy"] == 1.0
    assert balance.class_counts(df, "label") == (1, 1)
    assert explore.class_balance(df, "label").first()[:2] == (1, 1)


def test_nan_is_skipped(spark):
    xs = [float(i % 17) for i in range(200)]
    clean = spark.createDataFrame([(x,) for x in xs], "x double")
    dirty = spark.createDataFrame([(x,) for x in [*xs, float("nan"), None, float("nan")]], "x double")
    assert explore.auto_bins(dirty, "x") == explore.auto_bins(clean, "x")
    a, b = (explore.kde(d, "x", grid=20).orderBy("g").collect() for d in (clean, dirty))
    assert all(math.isclose(r["density"], s["density"], rel_tol=1e-12) for r, s in zip(a, b, strict=True))


@pytest.mark.parametrize("kind", ["skewed", "ties", "few"])
def test_bracketed_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(1)
    xs = {"skewed": np.exp(rng.normal(size=60_000) * 4), "ties": rng.integers(0, 5, 60_000).astype(float),
          "few": rng.normal(size=3)}[kind]
    df = spark.createDataFrame([(float(x), int(i)) for i, x in enumerate(xs)], "x double, i int").repartition(6)
    probs = [0.0, 0.0001, 0.05, 0.25, 0.5, 0.9, 0.99995, 1.0]
    got = {(r["column_name"], r["p"]): r["value"] for r in explore.exact_quantiles(df, ["x", "i"], probs).collect()}
    for p in probs:
        assert math.isclose(got["x", p], float(np.quantile(xs, p)), rel_tol=1e-12)
        assert math.isclose(got["i", p], float(np.quantile(np.arange(len(xs)), p)), rel_tol=1e-12, abs_tol=1e-9)


def test_any_number_of_labels(spark):
    df = spark.createDataFrame([(f"v{i % 1700}",) for i in range(5000)], "c string")
    out = features.string_index(df, "c")
    assert out.count() == 5000 and out.agg(F.countDistinct("c_index"), F.max("c_index")).first()[:2] == (1700, 1699.0)
    assert len(features.fit_categories(df, "c")) == 1700
    with pytest.raises(ValueError):
        features.fit_categories(df, "c", max_categories=1000)


def test_new_types_become_columns_or_raise(spark):
    t = S.txn(spark, SF_SMALL).withColumn("type", F.when(F.col("type") == "DEBIT", "WIRE").otherwise(F.col("type")))
    p = flow.prepare(t, dedupe=False)
    assert "type_WIRE" in flow.feature_columns(p) and "type_DEBIT" not in p.columns
    with pytest.raises(Exception, match="unseen label"):
        flow.prepare(t, categories={"type": S.TYPE_LABELS, "type2": S.TYPE2_LABELS}).collect()


def test_stratified_split_keeps_every_row(spark, monkeypatch):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 2).alias("y"))
    s = split.assign_split(df, "id", 0.7, stratify="y")
    counts = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert sum(counts.values()) == 3000
    assert all(counts[y, "train"] == round(0.7 * 1000) for y in (None, 0, 1))
    keyed = df.select(F.col("y").alias("_g"), F.col("id").alias("_k"), F.rand(1).alias("_u"))
    many = split.stratum_cuts(session.cut_lineage(keyed, "keyed"), 0.7, rows_per_bucket=40)
    assert many.count() == 3


def test_csv_columns_go_by_their_names(spark, tmp_path):
    t = S.txn(spark, SF_SMALL)
    cols = t.columns
    i, j = cols.index("nameOrig"), cols.index("nameDest")
    cols[i], cols[j] = cols[j], cols[i]
    path = files.write_csv(t.select(*cols), str(tmp_path / "swapped"))
    back = files.read_transactions_csv(spark, path, typed=True, key="event_id")
    want = {r["event_id"]: (r["nameOrig"], r["nameDest"]) for r in t.collect()}
    assert {r["event_id"]: (r["nameOrig"], r["nameDest"]) for r in back.collect()} == want
    with pytest.raises(ValueError, match="not in the header"):
        files.read_transactions_csv(spark, files.write_csv(t.drop("amount"), str(tmp_path / "short")))


def test_tuned_models_and_folds(spark):
    p = flow.prepared_features(spark, SF_SMALL)
    model, table = tune.tune("decision_tree", p, S.FEATURES, S.LABEL, "event_id", folds=2, grid={"maxDepth": [1, 3]})
    assert {r["params"] for r in table.collect()} == {"maxDepth=1", "maxDepth=3"}
    assert [r["param"] for r in tune.best_params(model).collect()] == ["maxDepth"]
    assert math.isclose(models.feature_importances(model, S.FEATURES).agg(F.sum("importance")).first()[0], 1.0)
    by_fold = tune.fold_metrics("decision_tree", p, S.FEATURES, S.LABEL, "event_id", folds=2, grid={"maxDepth": [1, 3]})
    means = {r["params"]: r["m"] for r in by_fold.groupBy("params").agg(F.avg("auc_roc").alias("m")).collect()}
    assert all(math.isclose(means[r["params"]], r["auc_roc"], rel_tol=1e-9) for r in table.collect())


def test_whole_profile(spark):
    t = S.txn_dirty(spark, SF_SMALL).select("step", "type", "amount", "isFraud")
    sections = profile.profile(t)
    assert set(sections) == {"numeric", "quantiles", "categorical", "top_values", "missing", "correlation", "alerts"}
    assert profile.profile_long(t).filter("section = 'numeric' AND item = 'n'").count() == 3
    assert profile.profile_long(t.limit(0)).count() > 0
