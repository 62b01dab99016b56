"""Counts, histograms, quantiles, box statistics and densities.

No RDD and no Python per row: a histogram is one min/max aggregate (two
scalars per column to the driver) followed by one ``groupBy(bin)``; many
columns share both passes by stacking them into long form.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import field, finite_sql
from ..functions.prefix import running_sums
from ..session import cut_lineage


# ---------------------------------------------------------------- A1 A2 A3
def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


def value_counts(df: DataFrame, col: str, with_share: bool = True) -> DataFrame:
    """(value, count[, share]) in descending count, ties by value (nulls counted)."""
    g = df.groupBy(field(col).alias(col)).agg(F.count(F.lit(1)).alias("count"))
    if with_share:
        g = cut_lineage(g, "value-counts")   # the rows are read once; the total comes from the counts
        total = g.agg(F.sum("count")).first()[0] or 0
        g = g.withColumn("share", F.round(F.col("count") / F.lit(max(total, 1)), 6))
    return g.orderBy(F.col("count").desc(), field(col).asc_nulls_first())


def class_balance(df: DataFrame, label: str = "isFraud", positive=1) -> DataFrame:
    """(n_majority, n_minority, ratio) for a binary label, one conditional aggregate."""
    pos = F.sum(F.when(field(label) == positive, 1).otherwise(0))
    neg = F.sum(F.when(field(label) != positive, 1).otherwise(0))
    a = df.agg(pos.cast("bigint").alias("_p"), neg.cast("bigint").alias("_n"))
    maj = F.greatest("_p", "_n")
    mino = F.least("_p", "_n")
    return a.select(maj.alias("n_majority"), mino.alias("n_minority"),
                    F.round(F.when(mino > 0, maj / mino), 6).alias("ratio"))


# ---------------------------------------------------------------- A4-A7
def _stack(df: DataFrame, cols: Sequence[str], value: str = "value") -> DataFrame:
    """Long form (column_name, value double) of the finite values."""
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.expr(finite_sql(c)).alias(value))
                    for c in cols])
    return df.select(F.explode(arr).alias("_s")).select("_s.column_name", f"_s.{value}").filter(F.col(value).isNotNull())


def non_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, n_null, n_nan, n_infinite): what the histograms, quantiles, box
    statistics and densities of a column leave out."""
    items = []
    for c in cols:
        x = field(c).cast("double")
        items.append((c, [F.count_if(x.isNull()), F.count_if(F.isnan(x)), F.count_if(F.abs(x) == F.lit(float("inf")))]))
    row = df.agg(*[e.alias(f"v{i}_{k}") for i, (_, es) in enumerate(items) for k, e in enumerate(es)])
    names = ("n_null", "n_nan", "n_infinite")
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"v{i}_{k}").alias(a) for k, a in enumerate(names)])
        for i, (c, _) in enumerate(items)])).alias("e")).select("e.*")


def _bin_of(x: Column, lo: float, width: float, bins: int) -> Column:
    return F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")


def histograms(df: DataFrame, cols: Sequence[str], bins: int | dict = 10) -> DataFrame:
    """Equal-width histograms of several columns in two passes.

    Per column: edges from min to max in ``bins`` steps, last bin closed,
    a constant column gives one bin; NULL, NaN and infinities are skipped
    (``non_finite`` counts them).  Output
    (column_name, bin, lo, hi, count), empty bins included; ``hi`` is the
    bar location of the reference plot (right edge)."""
    cols = list(cols)
    long = _stack(df, cols)
    # edges: one plain aggregate over the columns as they are (three small
    # buffers per column, no explode), three scalars per column to the driver
    aggs = []
    for i, c in enumerate(cols):
        valid = finite_sql(c)
        aggs += [f"min({valid}) AS lo{i}", f"max({valid}) AS hi{i}", f"count({valid}) AS n{i}"]
    row = df.agg(*[F.expr(a) for a in aggs]).first()
    nb = {c: (bins[c] if isinstance(bins, dict) else bins) for c in cols}
    bin_e = None
    specs = []
    for i, c in enumerate(cols):
        if not row[f"n{i}"]:
            continue
        lo, hi, b = float(row[f"lo{i}"]), float(row[f"hi{i}"]), int(nb[c])
        if lo == hi:
            b = 1
            e = F.lit(0)
        else:
            e = _bin_of(F.col("value"), lo, (hi - lo) / b, b)
        specs.append((c, lo, hi, b))
        bin_e = (F.when(F.col("column_name") == c, e) if bin_e is None
                 else bin_e.when(F.col("column_name") == c, e))
    spark = df.sparkSession
    schema = "column_name string, bin int, lo double, hi double, count bigint"
    if not specs:
        return spark.createDataFrame([], schema)
    counts = long.withColumn("bin", bin_e).groupBy("column_name", "bin").agg(
        F.count(F.lit(1)).alias("count"))
    # scaffold of all bins, generated from the per-column spec (bounded by columns x bins)
    spec_rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(lo).alias("lo0"),
                                   F.lit(hi).alias("hi0"), F.lit(b).alias("nbins"))
                          for c, lo, hi, b in specs])
    scaffold = (spark.range(1).select(F.explode(spec_rows).alias("s")).select("s.*")
                .withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("nbins") - 1))))
    width = (F.col("hi0") - F.col("lo0")) / F.col("nbins")
    out = scaffold.join(counts, ["column_name", "bin"], "left").select(
        "column_name", "bin",
        (F.col("lo0") + F.col("bin") * width).alias("lo"),
        F.when(F.col("bin") == F.col("nbins") - 1, F.col("hi0"))
         .otherwise(F.col("lo0") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))
    return out


def histogram(df: DataFrame, col: str, bins: int | str = 10) -> DataFrame:
    """(bin, lo, hi, count) of one column; ``bins='auto'`` uses NumPy's rule."""
    if bins == "auto":
        bins = auto_bins(df, col)
    return histograms(df, [col], int(bins)).drop("column_name")


# ---------------------------------------------------------------- quantiles
SKETCH = 10_000      # accuracy of the bracketing sketch: ranks within n / SKETCH


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column_name, p, value): linear-interpolated quantiles, exact and distributed.

    Pass one sketches each column (a buffer of fixed size for each) and takes two values
    that certainly enclose each wanted rank.  Pass two counts the rows below each bracket
    and the values inside it, a few ten-thousandths of the rows, and picks the wanted ranks
    from running sums of those counts.  Nothing of the size of the table is sorted or
    written.  NULL, NaN and infinities are skipped; a column without numbers has no rows."""
    cols, probs = list(cols), [float(p) for p in probs]
    spark = df.sparkSession
    schema = "column_name string, p double, value double"
    slack = 4.0 / SKETCH     # the sketch is off by 1 / SKETCH at most
    around = [min(1.0, max(0.0, p + d)) for p in probs for d in (-slack, slack)]
    aggs = []
    for i, c in enumerate(cols):
        valid = finite_sql(c)
        aggs += [F.expr(f"count({valid})").alias(f"n{i}"),
                 F.percentile_approx(F.expr(valid), around, SKETCH).alias(f"q{i}")]
    row = df.agg(*aggs).first()
    brackets, wanted = [], []
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        for k, p in enumerate(probs if n else []):
            h = (n - 1) * p
            j = int(math.floor(h))
            brackets.append((c, k, float(row[f"q{i}"][2 * k]), float(row[f"q{i}"][2 * k + 1])))
            wanted.append((c, k, p, h - j, j, min(j + 1, n - 1)))
    if not brackets:
        return spark.createDataFrame([], schema)
    # one row for each column and probability: bounded by the parameters
    b = F.broadcast(spark.createDataFrame(brackets, "column_name string, k int, lo double, hi double"))
    near = _stack(df, cols).join(b, "column_name")
    x = F.col("value")
    # counts of the values inside, one for all rows on either side, and the values next to them
    side = F.when(x < F.col("lo"), -1).when(x > F.col("hi"), 1).otherwise(0)
    near = near.withColumn("side", side).withColumn("inside", F.when(F.col("side") == 0, x).otherwise(0.0))
    counts = cut_lineage(near.groupBy("column_name", "k", "side", "inside").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("value").alias("least"), F.max("value").alias("most")), "quantile-brackets")
    cum = running_sums(counts, ["side", "inside"], ["cnt"], partition_cols=["column_name", "k"])
    at = F.broadcast(spark.createDataFrame(wanted, "column_name string, k int, p double, frac double, j bigint, j2 bigint"))
    hit = cum.join(at, ["column_name", "k"])

    def pick(index: str):
        start = F.col("cum_cnt") - F.col("cnt")
        value = (F.when((F.col("side") == 0) | ((F.col("side") == 1) & (start == F.col(index))), F.col("least"))
                 .when((F.col("side") == -1) & (F.col("cum_cnt") - 1 == F.col(index)), F.col("most"))
                 .otherwise(F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")))
        return F.max(F.when((start <= F.col(index)) & (F.col(index) < F.col("cum_cnt")), value))

    got = hit.groupBy("column_name", "p", "frac").agg(pick("j").alias("v1"), pick("j2").alias("v2"))
    return got.select("column_name", "p", (F.col("v1") + F.col("frac") * (F.col("v2") - F.col("v1"))).alias("value"))


def sketched_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], size: int = 400) -> DataFrame:
    """(column_name, p, value) from one KLL sketch for each column: one pass, a buffer of a few
    kilobytes, each rank within about 2.3 / size^0.9 of all (1 % at 400).  A value that
    occurs, not interpolated."""
    probs = [float(p) for p in probs]
    sketch = _stack(df, cols).groupBy("column_name").agg(F.kll_sketch_agg_double("value", F.lit(size)).alias("s"))
    at = F.array(*[F.lit(p) for p in probs])
    found = sketch.select("column_name", F.arrays_zip(at.alias("p"), F.kll_sketch_get_quantile_double("s", at).alias("value")).alias("q"))
    return found.select("column_name", F.explode("q").alias("q")).select("column_name", "q.p", "q.value")


# ---------------------------------------------------------------- A8
def box_stats(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Boxplot numbers per column: quartiles (linear interpolation; with ``exact=False`` from
    one sketch pass, ranks within about a percent), whiskers = most extreme values within
    1.5 IQR of the box, count of outliers, from one more pass with the fences as literals.
    NULL, NaN and infinities are skipped."""
    quartiles: dict[str, dict[float, float]] = {}
    three = [0.25, 0.5, 0.75]
    found = exact_quantiles(df, cols, three) if exact else sketched_quantiles(df, cols, three)
    for r in found.collect():    # three values for each column
        quartiles.setdefault(r["column_name"], {})[r["p"]] = r["value"]
    spark = df.sparkSession
    schema = ("column_name string, q1 double, median double, q3 double, iqr double, whisker_lo double, "
              "whisker_hi double, n_outliers bigint")
    found = [c for c in cols if c in quartiles]
    if not found:
        return spark.createDataFrame([], schema)
    aggs, items = [], []
    for i, c in enumerate(found):
        q1, q2, q3 = (quartiles[c][p] for p in (0.25, 0.5, 0.75))
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        x = f"({finite_sql(c)})"
        low, high = f"CAST('{lo!r}' AS DOUBLE)", f"CAST('{hi!r}' AS DOUBLE)"
        aggs += [f"min(CASE WHEN {x} >= {low} THEN {x} END) AS a{i}",
                 f"max(CASE WHEN {x} <= {high} THEN {x} END) AS b{i}",
                 f"count(CASE WHEN {x} < {low} OR {x} > {high} THEN 1 END) AS n{i}"]
        items.append(F.struct(F.lit(c).alias("column_name"), F.lit(q1).alias("q1"), F.lit(q2).alias("median"),
                              F.lit(q3).alias("q3"), F.lit(q3 - q1).alias("iqr"), F.col(f"a{i}").alias("whisker_lo"),
                              F.col(f"b{i}").alias("whisker_hi"), F.col(f"n{i}").alias("n_outliers")))
    row = df.agg(*[F.expr(a) for a in aggs])
    return row.select(F.explode(F.array(*items)).alias("e")).select("e.*")


# ---------------------------------------------------------------- A9
def _numbers(df: DataFrame, col: str) -> DataFrame:
    """The column's finite values as doubles, named ``x``."""
    return df.select(F.expr(finite_sql(col)).alias("x")).filter(F.col("x").isNotNull())


def auto_bins(df: DataFrame, col: str) -> int:
    """NumPy 'auto': the smaller width of Sturges and Freedman-Diaconis
    (Sturges alone when the IQR is 0), from one aggregate + quartiles."""
    df = _numbers(df, col)
    s = df.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")).first()
    if s["n"] == 0 or s["lo"] == s["hi"]:
        return 1
    lo, hi, n = float(s["lo"]), float(s["hi"]), int(s["n"])
    qs = {r["p"]: r["value"] for r in exact_quantiles(df, ["x"], [0.25, 0.75]).collect()}
    iqr = qs[0.75] - qs[0.25]
    sturges = (hi - lo) / (math.log2(n) + 1.0)
    fd = 2.0 * iqr * n ** (-1.0 / 3.0)
    width = min(fd, sturges) if fd > 0 else sturges
    return int(math.ceil((hi - lo) / width))


def kde(df: DataFrame, col: str, grid: int = 200, fine_bins: int = 2048) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth, evaluated on ``grid``
    points from min to max.  Rows are first binned into ``fine_bins`` (one
    pass); the kernel then runs over bins x grid, a size fixed by the two
    parameters and independent of the row count."""
    df = _numbers(df, col)
    s = df.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"),
               F.stddev_samp("x").alias("sd")).first()
    spark = df.sparkSession
    if not s["n"] or s["sd"] is None or s["sd"] == 0:
        return spark.createDataFrame([], "g int, x double, density double")
    lo, hi, n, sd = float(s["lo"]), float(s["hi"]), int(s["n"]), float(s["sd"])
    bw = sd * n ** (-1.0 / 5.0)
    width = (hi - lo) / fine_bins
    x = F.col("x")
    binned = (df
              .select(F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(fine_bins - 1)).alias("b"))
              .groupBy("b").agg(F.count(F.lit(1)).alias("c"))
              .select((F.lit(lo) + (F.col("b") + 0.5) * F.lit(width)).alias("center"), "c"))
    step = (hi - lo) / (grid - 1)
    pts = binned.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    gx = F.lit(lo) + F.col("g") * F.lit(step)
    z = (gx - F.col("center")) / F.lit(bw)
    contrib = F.col("c") * F.exp(-0.5 * z * z)
    norm = 1.0 / (n * bw * math.sqrt(2 * math.pi))
    return (pts.groupBy("g").agg(F.sum(contrib).alias("_s"))
            .select("g", (F.lit(lo) + F.col("g") * F.lit(step)).alias("x"),
                    (F.col("_s") * F.lit(norm)).alias("density")))
