"""Category-safe SMOTE, bootstrap, approximate neighbours, model tables, one-pass tuning,
checked CSV and the partitioned prepared table."""

import collections
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.functions.exprs import poisson_count
from ledgerlens.operators import balance, evaluate, knn, split
from ledgerlens.plans import bayes, models, nodes, tune
from ledgerlens.plans.flow import prepared_features
from ledgerlens.session import cut_lineage, scratch_dir
from ledgerlens.sources import files

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return cut_lineage(prepared_features(spark, MEDIUM), "test-prepared")


@pytest.fixture(scope="module")
def sides(rows):
    return split.split(rows, "event_id", 0.7, seed=0)


# ---------------------------------------------------------------- SMOTE with categories
def test_mixed_smote_keeps_categories_whole(spark):
    data = [(i, float(i % 7), i * 0.5, ["a", "b", None][i % 3], 1 if i % 4 == 0 else 0, i % 5 != 0, int(i < 12)) for i in range(60)]
    data = [(*r[:4], r[4], 1 - r[4], r[5], r[6]) for r in data]
    df = spark.createDataFrame(data, "id bigint, x double, y double, c string, g_a int, g_b int, flag boolean, label int")
    feats = ["x", "y", "c", "g_a", "g_b", "flag"]
    out = balance.smote(df.repartition(5), "label", feats, "id", k=3, categorical=["c", ["g_a", "g_b"], "flag"]).collect()
    assert len(out) == 48 - 12
    assert all(r.g_a + r.g_b == 1 and r.c in ("a", "b", None) and isinstance(r.flag, bool) for r in out)
    again = balance.smote(df.repartition(2), "label", feats, "id", k=3, categorical=["c", ["g_a", "g_b"], "flag"]).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mixed_distance_and_majority_by_hand(spark):
    # x has deviation 3 and y 1: the penalty is 4 (squared median deviation)
    xs = [-3.0, 3.0, -3.0, 3.0]
    data = [(i, xs[i], [1.0, -1.0, -1.0, 1.0][i], "uv"[i // 2], 1) for i in range(4)] + [(10 + i, 0.0, 0.0, "u", 0) for i in range(6)]
    df = spark.createDataFrame(data, "id bigint, x double, y double, c string, label int")
    mino = df.filter("label = 1").select("id", "x", "y", F.col("c").alias("_cat0"))
    points, axes = balance._with_penalties(mino, ["x", "y"], ["_cat0"], 10)
    got = {(r.id, r.neighbor_key): r.distance ** 2 for r in knn.knn_within(points, "id", axes, 3).collect()}
    assert got[0, 1] == pytest.approx(36 + 4) and got[0, 2] == pytest.approx(4 + 4) and got[0, 3] == pytest.approx(36 + 4)
    out = balance.smote(df, "label", ["x", "y", "c"], "id", k=3, categorical=["c"])
    # rows 0 and 1 have neighbours u, v, v; rows 2 and 3 have u, u, v
    of = {(r.x > 0, r.c) for r in out.collect()}
    assert {c for _, c in of} <= {"u", "v"} and out.count() == 2


def test_commonest_breaks_ties_by_label(spark):
    df = spark.createDataFrame([(["b", "a", None],), ([None, None, "z"],), (["c", "b", "c"],)], "s array<string>")
    v = df.select(F.transform("s", lambda x: F.struct(x.alias("_cat0"))).alias("v"))
    assert [r[0] for r in v.select(balance._commonest("_cat0")).collect()] == ["a", None, "c"]


def test_mixed_smote_refuses_what_it_cannot_do(spark):
    df = spark.createDataFrame([(i, float(i), "c%d" % i, int(i < 5)) for i in range(20)], "id bigint, x double, c string, label int")
    with pytest.raises(ValueError, match="numeric"):
        balance.smote(df, "label", ["c"], "id", categorical=["c"])
    with pytest.raises(ValueError, match="must be features"):
        balance.smote(df, "label", ["x"], "id", categorical=["c"])
    with pytest.raises(ValueError, match="max_categories"):
        balance.smote(df, "label", ["x", "c"], "id", categorical=["c"], max_categories=3)
    one = df.filter("id = 0 OR label = 0")
    assert balance.smote(one, "label", ["x", "c"], "id", categorical=["c"]).count() == 0
    b = balance.balance(df, "label", ["x", "c"], "id", categorical=["c"])
    assert b.filter("label = 1").count() == 15 and b.filter("c IS NULL").count() == 0


# ---------------------------------------------------------------- bootstrap
@pytest.mark.parametrize("rate", [0.2, 1.0, 6.8, 40.0, 1200.0])
def test_poisson_counts_follow_the_distribution(spark, rate):
    n = 4000
    got = np.array([r[0] for r in spark.range(n).select(poisson_count(rate, F.lit("s"), F.col("id"))).collect()])
    assert abs(got.mean() - rate) < 5 * math.sqrt(rate / n) and abs(got.var() / rate - 1) < 0.15
    if rate == 1.0:
        for k in range(4):
            assert abs((got == k).mean() - math.exp(-1) / math.factorial(k)) < 0.04


def test_bootstrap_is_the_same_for_any_partitioning(spark):
    df = spark.createDataFrame([(i if i else None, int(i % 9 == 0)) for i in range(900)], "id bigint, label int")
    a = balance.oversample_minority(df.repartition(7), "label", "id", mode="random")
    b = balance.oversample_minority(df.coalesce(1), "label", "id", mode="random")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    copies = collections.Counter(r.id for r in a.filter("label = 1").collect())
    assert 0 < len(copies) <= 100 and abs(sum(copies.values()) - 800) < 150 and max(copies.values()) > 10
    with pytest.raises(ValueError, match="mode"):
        balance.oversample_minority(df, "label", "id", mode="other")


# ---------------------------------------------------------------- approximate neighbours
def recall(exact, found):
    truth = collections.defaultdict(set)
    for r in exact.collect():
        truth[r[0]].add(r[2])
    got = collections.defaultdict(set)
    for r in found.collect():
        got[r[0]].add(r[2])
    assert set(got) == set(truth) and all(len(got[q]) == len(truth[q]) for q in truth)
    return sum(len(truth[q] & got[q]) for q in truth) / sum(map(len, truth.values()))


def test_approximate_neighbours_of_transactions(spark, rows):
    some = rows.filter(F.col("event_id") % 2 == 0)
    exact = cut_lineage(knn.knn_within(some, "event_id", S.FEATURES, 5), "exact")
    found = cut_lineage(knn.knn_within(some, "event_id", S.FEATURES, 5, strategy="approximate", leaf=128), "found")
    assert recall(exact, found) >= 0.9
    # distances are exact and ranked
    both = exact.withColumnRenamed("distance", "d").join(found, ["event_id", "neighbor_key"])
    assert both.filter(F.abs(F.col("d") - F.col("distance")) > 1e-9).count() == 0
    best = found.groupBy("event_id").agg(F.max("neighbor_rank").alias("m"), F.count("*").alias("c"))
    assert best.filter("m <> c").count() == 0


def test_approximate_neighbours_in_many_dimensions(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32)) * 4
    points = np.concatenate([c + rng.normal(size=(60, 32)) for c in centres])
    names = [f"f{i}" for i in range(32)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id bigint, " + ", ".join(f"{f} double" for f in names))
    exact = cut_lineage(knn.knn_within(df, "id", names, 5), "exact")
    assert recall(exact, knn.knn_within(df, "id", names, 5, strategy="approximate", leaf=128, tables=8)) >= 0.9


def test_work_of_the_approximate_search_grows_with_the_rows(spark):
    def met(n):
        rng = np.random.default_rng(1)
        df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.normal(size=(n, 4)))],
                                   "_key bigint, a double, b double, c double, d double")
        v = df.select("_key", F.array("a", "b", "c", "d").alias("v"), F.lit(True).alias("candidate"))
        sample = np.array([r["v"] for r in v.collect()])
        hashed = cut_lineage(knn._hashed(v, sample, "bigint", 2, 3, 0), "hashed")
        level = knn._level(hashed, n, 2, 100)
        sizes = hashed.select(F.expr(knn._cell_sql(0, 3, level)).alias("cell")).groupBy("cell").count()
        return sizes.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0], level
    (few, low), (many, high) = met(1000), met(8000)
    assert few <= 130 and many <= 130 and high > low


def test_approximate_neighbours_of_equal_and_few_rows(spark):
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(300)] + [(1000, 9.0, 9.0)], "id bigint, x double, y double")
    exact = knn.knn_within(same, "id", ["x", "y"], 3)
    assert recall(exact, knn.knn_within(same, "id", ["x", "y"], 3, strategy="approximate", leaf=4)) == 1.0
    few = same.limit(3)
    assert knn.knn_within(few, "id", ["x", "y"], 5, strategy="approximate").count() == 6
    assert knn.knn_within(same.limit(0), "id", ["x", "y"], 5, strategy="approximate").count() == 0
    assert knn.knn_within(same.limit(1), "id", ["x", "y"], 5, strategy="approximate").count() == 0
    with pytest.raises(ValueError, match="strategy"):
        knn.knn_within(few, "id", ["x", "y"], 5, strategy="other")
    mixed = spark.createDataFrame([(i, float(i % 13), float(i), int(i % 4 == 0)) for i in range(80)], "id bigint, x double, y double, l int")
    a = balance.smote(mixed, "l", ["x", "y"], "id")
    b = balance.smote(mixed, "l", ["x", "y"], "id", strategy="approximate")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))      # one cell: nothing is missed


# ---------------------------------------------------------------- model tables
def joined_scores(a, b):
    c = a.select("event_id", F.col("prediction").alias("p"), F.col("score").alias("s")).join(b, "event_id")
    return c.agg(F.count("*").alias("n"), F.max(F.abs(F.col("s") - F.col("score"))).alias("gap"),
                 F.sum((F.col("p") != F.col("prediction")).cast("int")).alias("other")).first()


WALK = """
WITH RECURSIVE x AS (UNPIVOT (SELECT event_id, {doubles} FROM rows) ON {features} INTO NAME feature VALUE v),
walk AS (SELECT event_id, tree, 0 AS node FROM (SELECT DISTINCT event_id FROM x), (SELECT DISTINCT tree FROM nodes)
  UNION ALL SELECT w.event_id, w.tree, CASE WHEN x.v <= n.threshold THEN n."left" ELSE n."right" END
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN x ON x.event_id = w.event_id AND x.feature = n.feature)
SELECT event_id, avg(stats[2] / list_sum(stats)) AS score FROM walk JOIN nodes USING (tree, node) WHERE feature IS NULL GROUP BY event_id"""


@pytest.mark.parametrize(("kind", "params"), [("decision_tree", {"maxDepth": 6}), ("random_forest", {"numTrees": 7}),
                                              ("decision_tree", {"maxDepth": 0})])
def test_trees_score_from_their_table(spark, sides, kind, params):
    train, test = sides
    model = models.train_model(kind, train, S.FEATURES, S.LABEL, seed=7, **params)
    table = cut_lineage(nodes.node_table(model, S.FEATURES), "nodes")
    mine = cut_lineage(nodes.score_nodes(test, table, S.FEATURES, S.LABEL, keep=["event_id"]), "scored")
    got = joined_scores(models.score(model, test, S.LABEL, keep=["event_id"]), mine)
    assert got.n == test.count() and got.gap < 1e-12 and got.other == 0
    # the same table read by SQL
    con = duckdb.connect()
    for name, df in (("nodes", table), ("rows", test.select("event_id", *S.FEATURES))):
        path = scratch_dir(spark, f"sql-{name}")
        df.write.parquet(path)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM read_parquet('{path.removeprefix('file://')}/*.parquet')")
    by_sql = dict(con.execute(WALK.format(features=", ".join(S.FEATURES),
                                          doubles=", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in S.FEATURES))).fetchall())
    assert len(by_sql) == got.n
    assert max(abs(by_sql[r.event_id] - r.score) for r in mine.collect()) < 1e-9
    if table.filter("feature IS NOT NULL").count():
        want = {r.feature: r.importance for r in models.feature_importances(model, S.FEATURES).collect() if r.importance}
        assert {r.feature: r.importance for r in nodes.importances(table).collect()} == pytest.approx(want)


def test_logistic_scores_from_its_table(spark, sides):
    train, test = sides
    model = models.train_model("logistic_regression", train, S.FEATURES, S.LABEL)
    table = models.coefficients(model, S.FEATURES)
    got = joined_scores(models.score(model, test, S.LABEL, keep=["event_id"]),
                        nodes.score_linear(test, table, S.LABEL, keep=["event_id"]))
    assert got.gap < 1e-12 and got.other == 0


def test_table_scorers_of_odd_input(spark, sides):
    train, test = sides
    table = cut_lineage(nodes.node_table(models.train_model("decision_tree", train, S.FEATURES, S.LABEL), S.FEATURES), "nodes")
    assert nodes.score_nodes(test.limit(0), table, S.FEATURES, S.LABEL).count() == 0
    with pytest.raises(Exception, match="missing value in feature amount"):
        nodes.score_nodes(test.withColumn("amount", F.lit(None).cast("double")), table, S.FEATURES, S.LABEL).collect()
    with pytest.raises(ValueError, match="lacks"):
        nodes.score_nodes(test, table, ["step"], S.LABEL)
    with pytest.raises(ValueError, match="no nodes"):
        nodes.node_table(models.train_model("naive_bayes", train, S.FEATURES, S.LABEL), S.FEATURES)


def test_depth_sweep_equals_separate_fits(spark, sides):
    train, test = sides
    noisy = [side.withColumn(S.LABEL, F.when(F.col("event_id") % 11 == 0, 1 - F.col(S.LABEL)).otherwise(F.col(S.LABEL))) for side in sides]
    depths = [1, 2, 3, 5, 8, 12]
    got = {r.value: (r.train_accuracy, r.test_accuracy)
           for r in tune.sweep("decision_tree", *noisy, S.FEATURES, S.LABEL, "maxDepth", depths).collect()}
    assert len({round(v[0], 6) for v in got.values()}) >= 4
    for d in depths:
        model = models.train_model("decision_tree", noisy[0], S.FEATURES, S.LABEL, maxDepth=d)
        want = [models.score(model, side, S.LABEL).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
                for side in noisy]
        assert got[float(d)] == pytest.approx(tuple(want), abs=1e-12), d


# ---------------------------------------------------------------- naive Bayes in one pass
def test_bayes_folds_equal_refits(spark, rows):
    values = [1.0, 5.0]
    got = {(r.smoothing, r.fold): r.auc_roc for r in bayes.fold_metrics(rows, S.FEATURES, S.LABEL, "event_id", values, 3).collect()}
    data = split.assign_folds(rows, "event_id", 3, 0, "fold")
    for fold in range(3):
        for v in values:
            model = models.train_model("naive_bayes", data.filter(F.col("fold") != fold), S.FEATURES, S.LABEL, smoothing=v)
            raw = models.score(model, data.filter(F.col("fold") == fold), S.LABEL, flat=False)
            from pyspark.ml.functions import vector_to_array
            r = vector_to_array("rawPrediction")
            want = evaluate.auc_roc(raw.select((r[1] - r[0]).alias("score"), F.col(S.LABEL).alias("label"))).first()[0]
            assert got[v, fold] == pytest.approx(want, abs=1e-9)


def test_tuned_bayes_is_the_best_value_refitted(spark, rows):
    model, table = tune.tune("naive_bayes", rows, S.FEATURES, S.LABEL, "event_id", grid={"smoothing": [0.0, 3.0, 3.0]})
    means = {r.params: r.auc_roc for r in table.collect()}
    assert set(means) == {"smoothing=0.0", "smoothing=3.0"}
    best = max(means, key=means.get)
    assert [(r.param, f"smoothing={r.value}") for r in tune.best_params(model).collect()] == [("smoothing", best)]
    assert model.bestModel.stages[-1].getSmoothing() == float(best.removeprefix("smoothing="))
    assert models.score(model, rows, S.LABEL).count() == rows.count()


def test_bayes_sweep_equals_fits(spark, sides):
    got = {r.value: (r.train_accuracy, r.test_accuracy) for r in bayes.sweep(*sides, S.FEATURES, S.LABEL, [1, 7]).collect()}
    for v in (1, 7):
        model = models.train_model("naive_bayes", sides[0], S.FEATURES, S.LABEL, smoothing=float(v))
        want = [models.score(model, side, S.LABEL).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
                for side in sides]
        assert got[float(v)] == pytest.approx(tuple(want), abs=1e-12)


def test_bayes_without_smoothing_and_with_odd_rows(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0, 0), (1, 2.0, 0.0, 0), (2, 0.0, 3.0, 1), (3, 0.0, 1.0, 1), (4, 1.0, 1.0, 1), (5, 0.0, 0.0, 0)],
                               "id bigint, a double, b double, y int")
    scorer = bayes.Scorer([bayes.log_parameters(bayes.class_sums(df, ["a", "b"], "y")[0], 0.0)])
    odds = scorer(np.array([[1.0, 0.0], [0.0, 2.0], [0.0, 0.0], [3.0, 1.0]]))[:, 0]
    # class 0 never saw b; class 1 saw both
    assert odds[1] == math.inf and odds[3] == math.inf and abs(odds[2]) < 1e-12 and np.isfinite(odds[0])
    folds = bayes.fold_metrics(df, ["a", "b"], "y", "id", [0.0, 1.0], folds=6).collect()
    assert len(folds) == 12 and any(r.auc_roc is None for r in folds)       # folds of one class
    assert bayes.sweep(df, df.limit(0), ["a", "b"], "y", [1.0]).first().test_accuracy is None
    for bad in ("NULL", "-1.0", "double('nan')"):
        with pytest.raises(ValueError, match="features"):
            bayes.class_sums(df.withColumn("b", F.expr(f"CASE WHEN id = 3 THEN {bad} ELSE b END")), ["a", "b"], "y")
    with pytest.raises(ValueError, match="labels"):
        bayes.class_sums(df.withColumn("y", F.lit(2)), ["a", "b"], "y")


def test_grouped_auc_equals_each_group(spark):
    df = spark.createDataFrame([(i % 3, float("inf") if i % 17 == 0 else float(i * 7 % 23), int(i % 5 < 2)) for i in range(300)],
                               "g int, score double, label int")
    got = {r.g: r.auc_roc for r in evaluate.auc_roc_by(df, ["g"]).collect()}
    for g in range(3):
        assert got[g] == pytest.approx(evaluate.auc_roc(df.filter(F.col("g") == g)).first()[0], abs=1e-12)


# ---------------------------------------------------------------- files
def test_quarantine_of_hand_written_lines(spark, tmp_path):
    head = "step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud"
    good = ["1,PAYMENT,9.5,C1,1,2,M1,0,0,0,0", '2,"PAY,MENT",,"C ""x"" 2",1,2,M1,0,0,0,0', ",,,,,,,,,,", "3,T,1e3,C,1,2,M,0,0,0,1"]
    bad = {"1,PAYMENT,9.5": ("too few fields", None), "1,P,9.5,C1,1,2,M1,0,0,0,0,0,0": ("too many fields", None),
           "x,PAYMENT,9.5,C1,1,2,M1,0,0,0,0": ("not a value of type int", "step"),
           '1,"a,b",nine,C1,1,2,M1,0,0,0,0': ("not a value of type double", "amount"),
           "1,P,9.5,C1,1,2,M1,0,0,0.5,zz": ("not a value of type int", "isFraud")}
    for name, lines in (("a.csv", [*good[:2], *list(bad)[:3]]), ("b.csv", [*good[2:], "", *list(bad)[3:]])):
        (tmp_path / name).write_text("\n".join([head, *lines]) + "\n")
    kept, out = files.read_transactions_csv_checked(spark, str(tmp_path))
    assert kept.count() == len(good) and dict(kept.dtypes)["amount"] == "double"
    assert {r.type for r in kept.collect()} == {"PAYMENT", "PAY,MENT", None, "T"}
    assert {r.line: (r.reason, r.failed_column) for r in out.collect()} == bad
    assert {os.path.basename(r.file) for r in out.collect()} == {"a.csv", "b.csv"}
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "c.csv").write_text(head + "\n")
    kept, out = files.read_transactions_csv_checked(spark, str(empty))
    assert kept.count() == 0 and out.count() == 0


def test_prepared_table_is_pruned_and_replaced_by_fold(spark, rows, capsys):
    data = split.assign_folds(rows, "event_id", 3, 0, "fold")
    path = files.write_prepared(data, scratch_dir(spark, "prepared"), partition_by=["fold"])
    one = files.read_table(spark, path).filter(F.col("fold") == 1)
    one.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(fold" in plan and len(one.inputFiles()) >= 1
    before = {f: n for f, n in files.read_table(spark, path).groupBy("fold").count().collect()}
    files.write_prepared(data.filter("fold = 1").limit(5), path, mode="overwrite", partition_by=["fold"])
    after = {f: n for f, n in files.read_table(spark, path).groupBy("fold").count().collect()}
    assert after == {**before, 1: 5}
    with pytest.raises(Exception, match="(?i)already exists"):
        files.write_prepared(data, path)


# ---------------------------------------------------------------- exact neighbours of noise
def test_exact_neighbours_move_once_for_each_group(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.r_[rng.standard_normal((2990, 16)), np.full((10, 16), 0.5)] + 100.0
    names = [f"x{i}" for i in range(16)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "id bigint, " + ", ".join(f"{c} double" for c in names))
    written = {}

    def kept(rows, name="stage"):
        written[name] = cut_lineage(rows, name)
        return written[name]

    monkeypatch.setattr(knn, "cut_lineage", kept)
    got = {(r.id, r.neighbor_rank): (r.neighbor_key, r.distance) for r in knn.knn_within(df, "id", names, 3).collect()}
    d2 = np.zeros((3000, 3000))
    for f in range(16):
        d2 += (v[:, f, None] - v[None, :, f]) ** 2
    np.fill_diagonal(d2, np.inf)
    best = np.argsort(d2, axis=1, kind="stable")[:, :3]
    assert got == {(i, r + 1): (int(best[i, r]), float(np.sqrt(d2[i, best[i, r]]))) for i in range(3000) for r in range(3)}
    # nothing can be pruned: every row would visit all 11 cells, but these form few groups
    assert written["knn-visits"].count() <= 3000 * 4


# ---------------------------------------------------------------- work done once
def test_model_roundtrip_joins_once(spark):
    from ledgerlens.plans import catalog
    out = catalog.QUERIES["model_roundtrip"](spark, SMALL)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    got = out.collect()
    assert [r.kind for r in got] == catalog._KINDS_TUNED and all(r.n == r.n_equal > 0 for r in got)


def test_profile_reads_its_rows_once(spark):
    from ledgerlens.operators import corr, profile
    df = spark.createDataFrame([(1, 2.0, None, "a"), (2, 4.0, 1.0, "b"), (3, 6.5, 0.0, "a"), (None, 1.0, 5.0, None)],
                               "a int, b double, c double, s string")
    sections = profile.profile(df)
    for name in ("missing", "correlation"):
        assert all("profile-rows" in f for f in sections[name].inputFiles()) and sections[name].inputFiles()
    # the pairs are rows of one aggregate, not columns of a method too large to be compiled
    plan = corr._pearson_pairwise(df, ["a", "b", "c"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("covar_pop") == 1
    r = {(x.feature_x, x.feature_y): x.correlation for x in sections["correlation"].collect()}
    assert len(r) == 9 and r["a", "c"] == r["c", "a"] == pytest.approx(-1.0) and r["b", "b"] == pytest.approx(1.0)
    assert r["a", "b"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1])
