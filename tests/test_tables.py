"""Wide correlation, sketches, values that are not finite, names with dots."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens import schema as S
from ledgerlens.operators import corr, explore, features, profile, sketches
from ledgerlens.session import cut_lineage, scratch_dir

MEDIUM = "/root/testdata/sf0.01"


def matrix(df, names):
    at = {n: i for i, n in enumerate(names)}
    out = np.full((len(names), len(names)), np.inf)
    for r in df.collect():
        assert out[at[r.feature_x], at[r.feature_y]] == np.inf
        out[at[r.feature_x], at[r.feature_y]] = np.nan if r.correlation is None else r.correlation
    assert not np.isinf(out).any()
    return out


# ---------------------------------------------------------------- wide correlation
@pytest.mark.parametrize(("block", "fan_in", "task_bytes"), [(128, 32, 64 << 20), (16, 2, 16 * 16 * 8 * 2)])
def test_wide_correlation_equals_numpy(spark, block, fan_in, task_bytes):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 50)) @ rng.normal(size=(50, 50)) * 10.0 ** rng.integers(-3, 4, 50) + 1e6
    x[:, 7] = 3.1                          # constant
    names = [f"c.{i}" for i in range(50)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"`{n}` double" for n in names)).repartition(9)
    got = matrix(corr._pearson_wide(df.select(*[F.col(f"`{n}`") for n in names]), names, block, fan_in, task_bytes), names)
    with np.errstate(all="ignore"):
        want = np.corrcoef(x.T)
    want[7], want[:, 7] = np.nan, np.nan
    assert np.allclose(got, want, atol=1e-7, equal_nan=True)


def test_wide_correlation_deletes_pairwise(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))
    gone = rng.random(x.shape) < 0.2
    gone[:, 3] = True                      # a column without values
    names = [f"c{i}" for i in range(12)]
    rows = [tuple(None if g else float(v) for v, g in zip(r, m, strict=True)) for r, m in zip(x, gone, strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4)
    wide = matrix(corr.correlation_matrix(df, names, wide=True), names)
    narrow = matrix(corr.correlation_matrix(df, names, wide=False), names)
    assert np.allclose(wide, narrow, atol=1e-9, equal_nan=True) and np.isnan(wide[3]).all()
    assert np.isnan(matrix(corr.correlation_matrix(df.limit(0), names, wide=True), names)).all()


def test_five_hundred_columns_in_one_pass(spark):
    e = S.table(spark, MEDIUM, "embeddings").select("embedding")
    names = [f"x{i}" for i in range(500)]
    wide = e.select(*[(F.col("embedding")[i % 64].cast("double") * (1 + i // 64) + F.col("embedding")[(i * 7) % 64] * (i // 64)).alias(n)
                      for i, n in enumerate(names)])
    got = cut_lineage(corr.correlation_matrix(wide, names), "wide")
    assert got.count() == 250_000
    some = names[:3] + names[200:203] + names[-2:]
    part = got.filter(F.col("feature_x").isin(some) & F.col("feature_y").isin(some))
    want = corr.correlation_matrix(wide, some, wide=False)
    assert np.allclose(matrix(part, some), matrix(want, some), atol=1e-9)


# ---------------------------------------------------------------- sketches
@pytest.fixture(scope="module")
def lineitem(spark):
    return cut_lineage(S.table(spark, MEDIUM, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_shipdate"), "li")


def test_merged_sketches_equal_those_of_the_whole(spark, lineitem):
    df = lineitem.drop("l_shipdate")
    nums, strs = ["l_orderkey", "l_extendedprice", "l_quantity"], ["l_returnflag"]
    half = F.col("l_orderkey") % 2 == 0
    path = scratch_dir(spark, "sketches")
    for part in (df.filter(half), df.filter(~half)):
        sketches.column_sketches(part, nums, strs).write.mode("append").parquet(path)       # stored as it comes
    merged = {r.column_name: r for r in sketches.sketch_statistics(sketches.merge_sketches(spark.read.parquet(path))).collect()}
    whole = {r.column_name: r for r in sketches.sketch_statistics(sketches.column_sketches(df, nums, strs)).collect()}
    exact = {r.column_name: r for r in profile.profile_numeric(df, nums).collect()}
    values = {c: np.sort([r[0] for r in df.select(F.col(c).cast("double")).collect()]) for c in nums}
    assert set(merged) == set(whole) == {*nums, *strs}
    for c in nums:
        for r in (merged[c], whole[c]):
            for f in ("n", "n_missing", "n_zeros", "n_negative", "min", "max"):
                assert r[f] == exact[c][f]
            for f in ("mean", "std", "variance", "skewness", "kurtosis", "sum"):
                assert r[f] == pytest.approx(exact[c][f], rel=1e-9, abs=1e-9), (c, f)
            assert abs(r.approx_distinct / exact[c].n_distinct - 1) < 0.06
            for p in (5, 25, 50, 75, 95):
                v = r[f"approx_p{p}"]
                lo, hi = (np.searchsorted(values[c], v, side=s) / len(values[c]) for s in ("left", "right"))
                assert lo - 0.015 <= p / 100 <= hi + 0.015
    assert merged["l_returnflag"].approx_distinct == 3 and merged["l_returnflag"].kind == "string"


def test_sketches_of_odd_values(spark):
    df = spark.createDataFrame([(None, "a", 1), (float("nan"), None, 1), (float("inf"), "", 2), (1.0, "b", 2), (-0.0, "b", 3)],
                               "`x.y` double, s string, g int")
    rows = {(r.g, r.column_name): r for r in sketches.sketch_statistics(sketches.column_sketches(df, ["x.y"], ["s"], by=["g"])).collect()}
    assert len(rows) == 6 and rows[1, "x.y"].n == 0 and rows[1, "x.y"].n_missing == 2 and rows[1, "x.y"].approx_p50 is None
    assert rows[2, "x.y"].max == float("inf") and rows[2, "x.y"].approx_p95 == 1.0
    all_ = {r.column_name: r for r in sketches.sketch_statistics(sketches.merge_sketches(
        sketches.column_sketches(df.filter("g <> 2"), ["x.y"], ["s"], by=["g"]))).collect()}
    assert all_["x.y"].n == 1 and all_["x.y"].n_zeros == 1 and all_["x.y"].mean == 0 and all_["s"].n == 2
    assert sketches.sketch_statistics(sketches.column_sketches(df.limit(0), ["x.y"], [])).count() == 0


@pytest.mark.parametrize("tracked", [16, 256, 4096])
def test_top_values_by_sketch_are_exact(spark, tracked):
    rows = [(f"v{min(i % 97, i % 5)}", i, ["a", "b"][i % 2], None if i % 3 else "x", float(i % 7)) for i in range(6000)]
    df = spark.createDataFrame(rows, "skewed string, distinct int, tied string, nulls string, number double").repartition(6)
    cols = ["skewed", "distinct", "tied", "nulls", "number"]
    got = sketches.top_values_sketched(df, cols, k=4, tracked=tracked).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, profile.top_values(df, cols, k=4).collect()))
    assert sketches.top_values_sketched(df.limit(0), cols, k=4).count() == 0
    assert sketches.top_values_sketched(df.select("number"), k=4).count() == 0


def test_settled_columns_are_not_counted_in_full(spark, monkeypatch):
    df = spark.createDataFrame([(["common", "other"][i % 3 == 0] if i % 2 else f"rare{i}", i) for i in range(8000)], "v string, i int")
    asked = []
    full = profile.top_values
    monkeypatch.setattr(sketches, "top_values", lambda d, cols, k: asked.append(cols) or full(d, cols, k))
    got = sketches.top_values_sketched(df, ["v"], k=2, tracked=512).collect()
    assert not asked and {(r.value, r.rank) for r in got} == {("common", 1), ("other", 2)}
    sketches.top_values_sketched(df, ["v", "i"], k=3, tracked=512).collect()
    assert asked == [["v", "i"]] or asked == [["i", "v"]]


def test_box_stats_from_a_sketch(lineitem):
    exact = {r.column_name: r for r in explore.box_stats(lineitem, ["l_extendedprice", "l_quantity"]).collect()}
    rough = {r.column_name: r for r in explore.box_stats(lineitem, ["l_extendedprice", "l_quantity"], exact=False).collect()}
    for c, e in exact.items():
        for f in ("q1", "median", "q3"):
            assert abs(rough[c][f] - e[f]) < 0.06 * (e.q3 - e.q1)


# ---------------------------------------------------------------- odd values and names
def test_infinities_are_left_out_and_counted(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, float("inf"), float("-inf"), float("nan"), None)], "`a.b` double")
    assert [r["count"] for r in explore.histogram(df, "a.b", 3).orderBy("bin").collect()] == [1, 1, 2]
    box = explore.box_stats(df, ["a.b"]).first()
    assert (box.q1, box.median, box.q3, box.whisker_lo, box.whisker_hi, box.n_outliers) == (1.75, 2.5, 3.25, 1.0, 4.0, 0)
    assert explore.auto_bins(df, "a.b") == 3 and explore.kde(df, "a.b", grid=5).count() == 5
    assert tuple(explore.non_finite(df, ["a.b"]).first()) == ("a.b", 1, 1, 2)
    none = df.filter("`a.b` IS NULL OR abs(`a.b`) = double('infinity')")
    assert explore.histogram(none, "a.b").count() == 0 and explore.box_stats(none, ["a.b"]).count() == 0
    assert explore.auto_bins(none, "a.b") == 1 and explore.kde(none, "a.b").count() == 0


def test_names_with_dots_and_ticks(spark):
    df = spark.createDataFrame([(float(i % 5), i * 0.5, "t" + str(i % 2)) for i in range(20)], "`a.b` double, `c``d` double, `s.t` string")
    assert explore.value_counts(df, "s.t").count() == 2 and explore.class_balance(df, "a.b").first().n_majority == 16
    assert explore.histograms(df, ["a.b", "c`d"], 4).count() == 8
    assert explore.exact_quantiles(df, ["a.b", "c`d"], [0.5]).count() == 2
    assert {r.column_name for r in profile.profile_missing(df).collect()} == {"a.b", "c`d", "s.t"}
    got = matrix(corr.correlation_matrix(df, ["a.b", "c`d"]), ["a.b", "c`d"])
    assert math.isclose(got[0, 0], 1.0) and np.allclose(got, got.T)
    assert np.allclose(got, matrix(corr.correlation_matrix(df, ["a.b", "c`d"], "spearman"), ["a.b", "c`d"]), atol=0.2)
    assert {r.feature for r in corr.target_correlation(df, "a.b", ["c`d"]).collect()} == {"c`d"}


def test_columns_of_labels_are_counted_first_and_never_twice(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), (None, 3, "x")], "t string, t_a int, _si_label string")
    with pytest.raises(ValueError, match="exist already: .'t_a'."):
        features.get_dummies(df, ["t"])
    with pytest.raises(ValueError, match="exist already"):
        features.one_hot_columns(df, "t", labels=["T_A"])
    with pytest.raises(ValueError, match="has 2 categories, more than max_categories = 1"):
        features.get_dummies(df.drop("t_a"), ["t"], max_categories=1)
    assert features.get_dummies(df, ["t", "t_a"]).columns == ["_si_label", "t_a", "t_b", "t_a_1", "t_a_2", "t_a_3"]
    indexed = features.string_index(df.filter("t IS NOT NULL"), "t")
    assert indexed.columns == ["t", "t_a", "_si_label", "t_index"]
    assert {(r.t, r.t_index, r._si_label) for r in indexed.collect()} == {("a", 0.0, "x"), ("b", 1.0, "y")}
