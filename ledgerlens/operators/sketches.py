"""A mergeable profile from sketches, and exact top values by sketch and recount (SURVEY §2.4,
A8, A10a-c, the inexact way).

``column_sketches`` reads a table once and keeps one row per column (and per value of ``by``, a
day or a fold): counts, moments, a KLL quantile sketch and a HyperLogLog sketch, each of a
fixed size.  The rows can be stored, merged over any grouping with ``merge_sketches``, and
read with ``sketch_statistics``; a new day's rows are sketched alone and merged with the old.
Counts, sums, extremes and moments are exact; quantile ranks are within about 1 % of the
rows and distinct counts within about 2 %, whatever was merged.  No table of values is written.

``top_values_sketched`` finds the k commonest values without counting all values.  A
heavy-hitter sketch of fixed size names candidates; a second pass counts these exactly.
Every value that is no candidate occurs at most 5.25 * rows / tracked times (the sketch's
worst error, twice), so where the k-th candidate occurs more often than that, the result is
exact.  Columns where it does not (many values of much the same frequency) are counted in
full by ``profile.top_values``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import field
from ..session import cut_lineage
from .profile import numeric_columns, string_columns, top_values

KLL_SIZE = 400
HLL_BITS = 12
TRACKED = 4096
_UNSEEN = 5.25      # times rows / tracked: the count that a value beyond the candidates can have

_MOMENTS = ("n", "n_missing", "n_zeros", "n_negative", "min", "max", "sum", "mean", "m2", "m3", "m4")


def column_sketches(df: DataFrame, numeric: Sequence[str] | None = None, strings: Sequence[str] | None = None,
                    by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_name, kind, counts and moments, quantiles, distinct): one row for each
    column and value of ``by``.  Of strings the moments are those of their lengths.  NaN
    counts as missing; infinities are kept out of the quantile sketch only."""
    numeric = numeric_columns(df, by) if numeric is None else list(numeric)
    strings = string_columns(df, by) if strings is None else list(strings)
    items = [F.struct(F.lit(c).alias("column_name"), F.lit("number").alias("kind"),
                      F.nullif(field(c).cast("double"), F.lit(float("nan"))).alias("x"),
                      F.nullif(field(c).cast("double"), F.lit(float("nan"))).cast("string").alias("v")) for c in numeric]
    items += [F.struct(F.lit(c).alias("column_name"), F.lit("string").alias("kind"),
                       F.length(field(c)).cast("double").alias("x"), field(c).alias("v")) for c in strings]
    keys = [*by, "column_name", "kind"]
    long = df.select(*[field(b).alias(b) for b in by], F.explode(F.array(*items)).alias("_e")).select(*[field(b) for b in by], "_e.*")
    x = F.col("x")
    g = long.groupBy(*keys).agg(
        F.count("x").alias("n"), F.count_if(x.isNull()).alias("n_missing"), F.count_if(x == 0).alias("n_zeros"),
        F.count_if(x < 0).alias("n_negative"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum("x").alias("sum"),
        F.avg("x").alias("mean"), F.var_pop("x").alias("_v"), F.skewness("x").alias("_s"), F.kurtosis("x").alias("_k"),
        F.kll_sketch_agg_double(F.when(F.abs(x) < float("inf"), x), F.lit(KLL_SIZE)).alias("quantiles"),
        F.hll_sketch_agg("v", F.lit(HLL_BITS)).alias("distinct"))
    n, v = F.col("n"), F.col("_v")
    zero = F.lit(0.0)
    return g.select(*keys, *_MOMENTS[:8], F.coalesce(n * v, zero).alias("m2"),
                    F.coalesce(F.col("_s") * n * F.pow(v, F.lit(1.5)), zero).alias("m3"),
                    F.coalesce((F.col("_k") + 3) * n * v * v, zero).alias("m4"), "quantiles", "distinct")


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``column_sketches`` merged over everything but ``by``; the union of two stored
    tables merges like one."""
    keys = [*by, "column_name", "kind"]
    w = Window.partitionBy(*keys)
    n, rows = F.col("n"), F.sum("n").over(w)
    together = sketches.withColumn("_mean", F.when(rows > 0, F.sum("sum").over(w) / rows))
    d = F.when(n > 0, F.col("mean") - F.col("_mean")).otherwise(0.0)
    m2, m3, m4 = F.col("m2"), F.col("m3"), F.col("m4")
    shifted = together.withColumns({
        "_m2": m2 + n * d * d, "_m3": m3 + 3 * d * m2 + n * d * d * d,
        "_m4": m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d})
    total = lambda c: F.sum(c).cast("bigint").alias(c)
    return shifted.groupBy(*keys).agg(
        total("n"), total("n_missing"), total("n_zeros"), total("n_negative"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.sum("sum").alias("sum"), F.first("_mean").alias("mean"), F.sum("_m2").alias("m2"), F.sum("_m3").alias("m3"),
        F.sum("_m4").alias("m4"), F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"))


def sketch_statistics(sketches: DataFrame, probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """What ``profile_numeric`` and ``profile_quantiles`` report, read from sketches: counts,
    extremes and moments exact, approx_distinct and approx_p<percent> within the bounds.  A
    row's leading columns are those of the sketches."""
    keep = [c for c in sketches.columns if c not in (*_MOMENTS, "quantiles", "distinct")]
    n, m2 = F.col("n").cast("double"), F.col("m2")
    var = F.when(n > 1, m2 / (n - 1))
    skew = F.when((n > 2) & (m2 > 0), F.sqrt(n * (n - 1)) / (n - 2) * (F.col("m3") / n) / F.pow(m2 / n, F.lit(1.5)))
    kurt = F.when((n > 3) & (m2 > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (F.col("m4") * n / (m2 * m2) - 3) + 6))
    has = F.kll_sketch_get_n_double("quantiles") > 0
    return sketches.select(
        *[field(c) for c in keep], "n", "n_missing", F.hll_sketch_estimate("distinct").alias("approx_distinct"), "n_zeros",
        "n_negative", "min", "max", "mean", F.sqrt(var).alias("std"), var.alias("variance"), skew.alias("skewness"),
        kurt.alias("kurtosis"), "sum",
        *[F.when(has, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p)))).alias(f"approx_p{int(round(p * 100))}")
          for p in probs])


def _texts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value, shown): every non-null value as text; equal numbers have one text."""
    types = dict(df.dtypes)

    def text(c: str) -> Column:
        return field(c) if types[c] == "string" else (field(c).cast("double") + F.lit(0.0)).cast("string")

    items = [F.struct(F.lit(c).alias("column_name"), text(c).alias("value"), field(c).cast("string").alias("shown")) for c in cols]
    return df.select(F.explode(F.array(*items)).alias("e")).select("e.*").filter(F.col("value").isNotNull())


def top_values_sketched(df: DataFrame, cols: Sequence[str] | None = None, k: int = 5, tracked: int = TRACKED) -> DataFrame:
    """(column_name, value, count, rank) as ``profile.top_values``, exact: the candidates of a
    heavy-hitter sketch are counted, and columns that the sketch's bound does not settle are
    counted in full."""
    cols = list(cols) if cols else string_columns(df)
    schema = "column_name string, value string, count bigint, rank int"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    long = _texts(df, cols)
    sketch = long.groupBy("column_name").agg(F.count(F.lit(1)).alias("rows"),
                                             F.expr(f"approx_top_k_accumulate(value, {int(tracked)})").alias("s"))
    # at most ``tracked`` candidates for each column
    names = cut_lineage(sketch.select("column_name", "rows", F.expr(f"approx_top_k_estimate(s, {int(tracked)})").alias("e")),
                        "top-candidates")
    candidates = names.select("column_name", F.explode("e.item").alias("value"))
    counted = cut_lineage(long.join(F.broadcast(candidates), ["column_name", "value"]).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("count"), F.min("shown").alias("shown")), "top-counted")
    order = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("shown"))
    top = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # settled: all values counted, or the k-th above what an unseen value can have
    state = names.select("column_name", "rows").join(
        counted.groupBy("column_name").agg(F.sum("count").alias("seen")), "column_name", "left").join(
        top.filter(F.col("rank") == k).select("column_name", F.col("count").alias("kth")), "column_name", "left")
    sure = (F.col("seen") == F.col("rows")) | (F.col("kth") > F.col("rows") * (_UNSEEN / tracked))
    open_ = [r["column_name"] for r in state.filter(~F.coalesce(sure, F.lit(False))).collect()]     # column names
    out = top.filter(~F.col("column_name").isin(open_)) if open_ else top
    out = out.select("column_name", F.col("shown").alias("value"), "count", F.col("rank").cast("int").alias("rank"))
    return out.unionByName(top_values(df, open_, k)) if open_ else out
