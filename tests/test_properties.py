"""Properties and edge cases, on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlens import schema as S
from ledgerlens.functions.prefix import global_rank, running_sums
from ledgerlens.operators import balance, clean, corr, evaluate, explore, features, knn, split
from ledgerlens.plans import models as M
from ledgerlens.plans.flow import prepared_features


@pytest.fixture(scope="module")
def feat(spark):
    return prepared_features(spark, SF_SMALL).cache()


# ---------------------------------------------------------------- running sums
@pytest.mark.parametrize("buckets", [1, 3, 16, 80])  # 80: Spark range partitioner path
def test_running_sums_match_cumsum(spark, buckets):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 50, 400).tolist()  # many ties in the first key
    df = spark.createDataFrame([(int(v), i, float(i % 7)) for i, v in enumerate(vals)], "v int, k int, w double")
    out = running_sums(df, ["v", "k"], ["w"], buckets=buckets).toPandas().sort_values(["v", "k"])
    assert np.allclose(out["cum_w"].to_numpy(), out["w"].cumsum().to_numpy())


def test_running_sums_partitioned(spark):
    df = spark.createDataFrame([(g, i, 1) for g in ("a", "b", "c") for i in range(50)], "g string, i int, one int")
    out = running_sums(df, ["i"], ["one"], partition_cols=["g"], buckets=4).toPandas()
    for _, grp in out.groupby("g"):
        assert sorted(grp["cum_one"]) == list(range(1, 51))


@pytest.mark.parametrize("buckets", [8, 80])
def test_global_rank_hot_value(spark, buckets):
    # a third of the rows share one value: ranks stay unique, dense and in order
    df = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(300)], "v int, k int")
    r = global_rank(df, ["v", "k"], "rank", buckets=buckets).toPandas().sort_values(["v", "k"])
    assert r["rank"].tolist() == list(range(1, 301))


def test_running_sums_partitioned_partitioner_path(spark):
    df = spark.createDataFrame([(g, i, 1) for g in ("a", "b", "c") for i in range(50)], "g string, i int, one int")
    out = running_sums(df, ["i"], ["one"], partition_cols=["g"], buckets=70).toPandas()
    for _, grp in out.groupby("g"):
        assert grp.sort_values("i")["cum_one"].tolist() == list(range(1, 51))


# ---------------------------------------------------------------- features
def test_one_hot_rows_sum_to_one(spark):
    t = features.one_hot_columns(S.txn(spark, SF_SMALL), "type")
    s = t.select(sum(F.col(c) for c in S.TYPE_LABELS).alias("s")).distinct().collect()
    assert [r["s"] for r in s] == [1.0]


def test_unseen_category_raises(spark):
    t = S.txn(spark, SF_SMALL)
    with pytest.raises(Exception):
        features.string_index(t, "type", labels=["CASH_IN"]).collect()
    kept = features.string_index(t, "type", labels=["CASH_IN"], handle_invalid="keep")
    assert kept.filter(F.col("type_index") == 1.0).count() > 0


def test_string_decimal_to_int(spark):
    df = spark.createDataFrame([("9839.64",), ("-1.9",)], "amount string")
    assert [r[0] for r in features.cast_columns(df, {"amount": "int"}).collect()] == [9839, -1]


def test_label_not_a_feature(spark, feat):
    with pytest.raises(ValueError):
        features.assemble(feat, S.FEATURES + [S.LABEL], label=S.LABEL)


# ---------------------------------------------------------------- explore
def test_histogram_counts_sum_to_non_null(spark):
    t = S.txn_dirty(spark, SF_SMALL)
    h = explore.histogram(t, "amount", 15)
    assert h.agg(F.sum("count")).first()[0] == t.filter(F.col("amount").isNotNull()).count()
    assert h.count() == 15


def test_histogram_constant_and_empty(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "x double")
    h = explore.histogram(df, "x", 10).collect()
    assert len(h) == 1 and h[0]["count"] == 4
    assert explore.histogram(df.filter("x > 9"), "x", 10).count() == 0


def test_profile_numeric_matches_pandas(spark):
    import pandas as pd
    from ledgerlens.operators import profile
    rng = np.random.default_rng(9)
    x = rng.gamma(2.0, 3.0, 300).round(2)
    x[::17] = np.nan  # missing values
    ints = rng.integers(-3, 4, 300)
    pdf = pd.DataFrame({"x": x, "i": ints, "c": 7.0})
    rows = [(None if np.isnan(a) else float(a), int(b), float(c)) for a, b, c in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "x double, i int, c double")
    got = {r["column_name"]: r for r in profile.profile_numeric(df).collect()}
    for col in ("x", "i"):
        s_ = pdf[col].dropna().astype(float)
        r = got[col]
        assert r["n"] == len(s_) and r["n_missing"] == 300 - len(s_)
        assert r["n_distinct"] == s_.nunique()
        assert r["n_zeros"] == int((s_ == 0).sum()) and r["n_negative"] == int((s_ < 0).sum())
        for name, want in (("mean", s_.mean()), ("std", s_.std()), ("variance", s_.var()),
                           ("skewness", s_.skew()), ("kurtosis", s_.kurt()), ("sum", s_.sum())):
            assert math.isclose(r[name], want, rel_tol=1e-9, abs_tol=1e-9), (col, name)
    assert got["c"]["n_distinct"] == 1 and got["c"]["std"] == 0.0
    empty = {r["column_name"]: r for r in profile.profile_numeric(df.filter("i > 99")).collect()}
    assert set(empty) == {"x", "i", "c"} and all(r["n"] == 0 and r["n_distinct"] == 0 for r in empty.values())


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    xs = rng.normal(size=501).round(2).tolist()
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    q = {r["p"]: r["value"] for r in explore.exact_quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.9]).collect()}
    for p, v in q.items():
        assert math.isclose(v, float(np.quantile(xs, p)), rel_tol=1e-9, abs_tol=1e-12)


def test_class_balance_one_class(spark):
    df = spark.createDataFrame([(0,)] * 5, "isFraud int")
    r = explore.class_balance(df).first()
    assert r["n_minority"] == 0 and r["ratio"] is None


# ---------------------------------------------------------------- correlation
def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(10)], "a double, b double")
    m = {(r["feature_x"], r["feature_y"]): r["correlation"] for r in corr.correlation_matrix(df, ["a", "b"]).collect()}
    assert m[("a", "b")] is None and m[("a", "a")] == 1.0


def test_pearson_matches_numpy_with_nulls(spark):
    rows = [(float(i), float((i * 7) % 11) if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double")
    r = [x for x in corr.correlation_matrix(df, ["a", "b"]).collect()
         if x["feature_x"] == "a" and x["feature_y"] == "b"][0]["correlation"]
    pairs = np.array([(a, b) for a, b in rows if b is not None])
    assert math.isclose(r, float(np.corrcoef(pairs[:, 0], pairs[:, 1])[0, 1]), rel_tol=1e-9)


# ---------------------------------------------------------------- evaluation
def test_metrics_identities(spark):
    s = S.rule_scores(spark, SF_SMALL)
    m = evaluate.classification_metrics(s).first()
    assert math.isclose(m["weighted_recall"], m["accuracy"], rel_tol=1e-12)
    cm = evaluate.confusion_matrix(s)
    assert cm.agg(F.sum("count")).first()[0] == s.count()


def test_roc_monotone_and_auc_matches_spark(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    s = S.rule_scores(spark, SF_SMALL)
    roc = evaluate.roc_curve(s).toPandas().sort_values(["fpr", "tpr"])
    assert roc.iloc[0][["fpr", "tpr"]].tolist() == [0.0, 0.0]
    assert roc.iloc[-1][["fpr", "tpr"]].tolist() == [1.0, 1.0]
    assert (np.diff(roc["tpr"]) >= 0).all()
    auc = evaluate.auc_roc(s).first()[0]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    ref = ev.evaluate(s.withColumn("label", F.col("label").cast("double")))
    assert math.isclose(auc, ref, rel_tol=1e-9)
    assert math.isclose(evaluate.curve_area(s).first()[0], auc, rel_tol=1e-12)


# ---------------------------------------------------------------- split
def test_split_disjoint_complete_partition_free(spark):
    t = S.txn(spark, SF_SMALL).select("event_id")
    a = split.assign_split(t, "event_id").toPandas().set_index("event_id")["split"]
    b = split.assign_split(t.repartition(7), "event_id").toPandas().set_index("event_id")["split"]
    assert len(a) == t.count() and a.sort_index().equals(b.sort_index())


def test_stratified_split_exact_shares(spark):
    t = S.txn(spark, SF_SMALL).select("event_id", "isFraud")
    s = split.assign_split(t, "event_id", 0.7, stratify="isFraud")
    got = {(r["isFraud"], r["split"]): r["count"] for r in s.groupBy("isFraud", "split").count().collect()}
    for c in (0, 1):
        n = got.get((c, "train"), 0) + got.get((c, "test"), 0)
        assert got.get((c, "train"), 0) == round(n * 0.7)


# ---------------------------------------------------------------- kNN / SMOTE
def _brute_knn(pts, k):
    keys = list(pts)
    out = {}
    for a in keys:
        d = sorted((sum((x - y) ** 2 for x, y in zip(pts[a], pts[b])), b) for b in keys if b != a)
        out[a] = [b for _, b in d[:k]]
    return out


@pytest.mark.parametrize("block", [knn.BLOCK, 8])
def test_knn_exact_vs_brute_force(spark, feat, block, monkeypatch):
    monkeypatch.setattr(knn, "ROWS_PER_PIVOT", 5)
    m = feat.filter(F.col(S.LABEL) == 1)
    got = knn.knn_within(m, "event_id", S.FEATURES, 5, block=block).toPandas()
    pts = {r["event_id"]: [float(r[f]) for f in S.FEATURES] for r in m.collect()}
    want = _brute_knn(pts, 5)
    for key, grp in got.groupby("event_id"):
        assert grp.sort_values("neighbor_rank")["neighbor_key"].tolist() == want[key]
    assert set(got["event_id"]) == set(pts)


def test_knn_high_dimension(spark, monkeypatch):
    # 24-d noise: hardly a cell can be left out
    monkeypatch.setattr(knn, "ROWS_PER_PIVOT", 10)
    rng = np.random.default_rng(4)
    xs = rng.normal(size=(150, 24)).round(3)
    cols = [f"x{i}" for i in range(24)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(xs)],
                               "k int, " + ", ".join(f"{c} double" for c in cols))
    got = knn.knn_tables(df, "k", cols, 3, block=4, visits=30)[0].toPandas()
    want = _brute_knn({i: list(map(float, r)) for i, r in enumerate(xs)}, 3)
    for key, grp in got.groupby("k"):
        assert grp.sort_values("neighbor_rank")["neighbor_key"].tolist() == want[key]
    assert len(got) == 150 * 3


def test_knn_prunes_clusters(spark, monkeypatch):
    """64-d clusters: rows visit few of the cells, so few of all pairs are compared."""
    monkeypatch.setattr(knn, "ROWS_PER_PIVOT", 20)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 64)) * 50
    xs = np.concatenate([c + rng.normal(size=(30, 64)) for c in centres]).round(4)
    cols = [f"x{i}" for i in range(64)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(xs)],
                               "k int, " + ", ".join(f"{c} double" for c in cols))
    seen = []
    visits = knn._visits
    monkeypatch.setattr(knn, "_visits", lambda *a: seen.append(visits(*a)) or seen[-1])
    got = knn.knn_within(df, "k", cols, 3).toPandas()
    want = _brute_knn({i: list(map(float, r)) for i, r in enumerate(xs)}, 3)
    for key, grp in got.groupby("k"):
        assert grp.sort_values("neighbor_rank")["neighbor_key"].tolist() == want[key]
    assert len(got) == 600 * 3
    cells = seen[0].select("cell").distinct().count()
    assert seen[0].count() < 600 * cells / 3


def test_knn_refuses_missing_features(spark):
    for bad in (None, float("nan")):
        df = spark.createDataFrame([(1, 1.0), (2, bad), (3, 2.0)], "k int, x double")
        with pytest.raises(ValueError, match="NULL or NaN"):
            knn.knn_within(df, "k", ["x"], 1)


def test_knn_hot_duplicates(spark):
    # a third of the points are identical: no all-pairs blow-up, exact answer
    rows = [(i, 0.0, 0.0) if i % 3 == 0 else (i, float(i), float(i % 13)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = knn.knn_within(df, "id", ["x", "y"], 3, block=8).toPandas()
    cand = knn._candidates(df.select(F.col("id").alias("_key"), F.array("x", "y").alias("v")), 3, 240)
    assert cand.filter("candidate").count() == 160 + 4       # of the 80 equal rows only four
    want = _brute_knn({i: [x, y] for i, x, y in rows}, 3)
    for key, grp in got.groupby("id"):
        assert grp.sort_values("neighbor_rank")["neighbor_key"].tolist() == want[key]


def test_smote_rows_on_segments(spark, feat):
    syn = balance.smote(feat, S.LABEL, ["step", "amount"], "event_id", k=3, seed=1)
    maj, mino = balance.class_counts(feat, S.LABEL)
    assert syn.count() == maj - mino
    m = feat.filter(F.col(S.LABEL) == 1).agg(F.min("amount"), F.max("amount")).first()
    r = syn.agg(F.min("amount"), F.max("amount")).first()
    assert m[0] <= r[0] and r[1] <= m[1]


def test_oversample_noop_when_balanced(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "k long, isFraud int")
    assert balance.oversample_minority(df, "isFraud", "k").count() == 10


def test_drop_duplicates_keeps_smallest_key(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "k long, v string")
    got = sorted(tuple(r) for r in clean.drop_duplicates(df, keep_by="k").collect())
    assert got == [(1, "a"), (2, "b")]


# ---------------------------------------------------------------- models
def test_naive_bayes_closed_form_equals_spark(spark, feat):
    stats = {(r["label"], r["term"]): r["log_prob"]
             for r in M.naive_bayes_stats(feat, S.FEATURES, S.LABEL, 1.0).collect()}
    model = M.train_model("naive_bayes", feat, S.FEATURES, S.LABEL, smoothing=1.0).stages[-1]
    pi, theta = model.pi.toArray(), model.theta.toArray()
    for c in (0, 1):
        assert math.isclose(pi[c], stats[(float(c), "(prior)")], rel_tol=1e-9)
        for j, f in enumerate(S.FEATURES):
            assert math.isclose(theta[c][j], stats[(float(c), f)], rel_tol=1e-9)


def test_model_roundtrip(spark, feat, tmp_path):
    from ledgerlens.sources.models import load_model, save_model
    for kind in M.KINDS:
        model = M.train_model(kind, feat, S.FEATURES, S.LABEL, seed=3)
        path = save_model(model, str(tmp_path / kind))
        again = load_model(path, spark)
        a = M.score(model, feat, S.LABEL, keep=["event_id"]).orderBy("event_id").collect()
        b = M.score(again, feat, S.LABEL, keep=["event_id"]).orderBy("event_id").collect()
        assert a == b


# ---------------------------------------------------------------- streaming
def test_prepare_stream_matches_batch(spark, tmp_path):
    from ledgerlens.plans.flow import prepare
    from ledgerlens.streaming import prepare_stream, read_transactions_stream
    src = str(tmp_path / "in")
    S.txn(spark, SF_SMALL).write.parquet(src)
    stream = prepare_stream(read_transactions_stream(spark, src))
    q = stream.writeStream.format("memory").queryName("prep_stream").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM prep_stream")
    want = prepare(S.txn(spark, SF_SMALL), dedupe=False)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
