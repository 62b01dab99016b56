"""Full table profile as Spark jobs.

* numeric columns: one plain aggregate (beyond two columns in long form, grouped by
  column), skewness and kurtosis with the sample corrections a pandas-based
  profiler reports; distinct counts from distinct (column number, double) pairs;
* strings: one written table of (column, value, count) serves distinct counts, lengths and
  top values; it is combined on the map side, so a value held by a third of the
  rows is one row for each task; numbers are never written as text;
* quantiles: exact, by bracketing (``explore.exact_quantiles``);
* missing values, duplicates, and alerts as rules over those rows;
* ``profile`` gives all sections of a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import clean
from ..session import cut_lineage
from .explore import exact_quantiles

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if (t in _NUMERIC or t.startswith("decimal")) and c not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c not in exclude]


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def value_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value, count) of the non-null values of each column as strings,
    written once; numbers have one text for each value."""
    types = dict(df.dtypes)
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), (
        F.col(_q(c)) if types[c] == "string" else F.col(_q(c)).cast("double") + F.lit(0.0)).cast("string").alias("value"),
        F.col(_q(c)).cast("string").alias("shown")) for c in cols])
    long = df.select(F.explode(arr).alias("e")).select("e.*").filter(F.col("value").isNotNull())
    return cut_lineage(long.groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("count"), F.min("shown").alias("shown")), "profile-values")


WIDE_COLUMNS = 2      # up to here one plain aggregate; more make a method too large to be compiled, so the long form


def _numeric_aggregates(x: str) -> dict[str, str]:
    n = f"CAST(count({x}) AS DOUBLE)"
    return {"n": f"count({x})", "n_missing": f"CAST(count(1) - count({x}) AS BIGINT)",
            "n_zeros": f"CAST(coalesce(sum(CASE WHEN {x} = 0 THEN 1 ELSE 0 END), 0) AS BIGINT)",
            "n_negative": f"CAST(coalesce(sum(CASE WHEN {x} < 0 THEN 1 ELSE 0 END), 0) AS BIGINT)",
            "min": f"min({x})", "max": f"max({x})", "mean": f"avg({x})", "std": f"stddev_samp({x})",
            "variance": f"var_samp({x})",
            "skewness": f"CASE WHEN {n} > 2 THEN sqrt({n} * ({n} - 1)) / ({n} - 2) * skewness({x}) END",
            "kurtosis": f"CASE WHEN {n} > 3 THEN ({n} - 1) / (({n} - 2) * ({n} - 3)) * (({n} + 1) * kurtosis({x}) + 6) END",
            "sum": f"sum({x})"}


def profile_numeric(df: DataFrame, cols: Sequence[str] | None = None, exact_distinct: bool = True,
                    values: DataFrame | None = None) -> DataFrame:
    """(column_name, data_type, n, n_missing, n_distinct, n_zeros, n_negative, min, max,
    mean, std, variance, skewness, kurtosis, sum) per numeric column, from one pass over
    the rows.  Exact distinct counts come from ``values`` (a ``value_table``) if given, else
    from a second pass that shuffles distinct (column number, double) pairs, no text.
    An empty table has a row with n = 0 for each column."""
    cols = list(cols) if cols else numeric_columns(df)
    types = dict(df.dtypes)
    spark = df.sparkSession
    spec = spark.createDataFrame([(i, c, types[c]) for i, c in enumerate(cols)], "_i int, column_name string, data_type string")
    stats = list(_numeric_aggregates("x"))
    doubles = [f"CAST({_q(c)} AS DOUBLE)" for c in cols]
    if not exact_distinct:
        stats.append("n_distinct")
    if len(cols) <= WIDE_COLUMNS:
        aggs = []
        for i, x in enumerate(doubles):
            own = _numeric_aggregates(x) | ({} if exact_distinct else {"n_distinct": f"CAST(approx_count_distinct({x}) AS BIGINT)"})
            aggs += [f"{e} AS a{i}_{k}" for k, e in enumerate(own.values())]
        row = df.agg(*[F.expr(e) for e in aggs])
        rows = F.array(*[F.struct(F.lit(i).alias("_i"), *[F.col(f"a{i}_{k}").alias(a) for k, a in enumerate(stats)])
                         for i in range(len(cols))])
        out = row.select(F.explode(rows).alias("e")).select("e.*")
    else:
        own = _numeric_aggregates("x") | ({} if exact_distinct else {"n_distinct": "CAST(approx_count_distinct(x) AS BIGINT)"})
        out = _numbered(df, doubles).groupBy("_i").agg(*[F.expr(e).alias(a) for a, e in own.items()])
    # both sides of these joins hold one row per profiled column
    out = F.broadcast(spec).join(out, "_i", "left")
    if exact_distinct:
        if values is None:
            distinct = _numbered(df, doubles).filter(F.col("x").isNotNull()).distinct().groupBy("_i").agg(
                F.count(F.lit(1)).alias("n_distinct"))
            out = out.join(F.broadcast(distinct), "_i", "left")
        else:
            distinct = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
            out = out.join(F.broadcast(distinct), "column_name", "left")
    counts = ["n", "n_missing", "n_distinct", "n_zeros", "n_negative"]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in counts}).select(
        "column_name", "data_type", *counts, "min", "max", "mean", "std", "variance", "skewness", "kurtosis", "sum")


def _numbered(df: DataFrame, doubles: Sequence[str]) -> DataFrame:
    """Long form (_i, x): column numbers and values as doubles."""
    items = ", ".join(f"named_struct('_i', {i}, 'x', {x})" for i, x in enumerate(doubles))
    return df.select(F.explode(F.expr(f"array({items})")).alias("e")).select("e.*")


def profile_quantiles(df: DataFrame, cols: Sequence[str] | None = None,
                      probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(column_name, p5, p25, p50, p75, p95, range, iqr), exact; the range is that of the
    0- and 1-quantiles, from the same passes."""
    cols = list(cols) if cols else numeric_columns(df)
    q = exact_quantiles(df, cols, [0.0, *probs, 1.0])
    names = {p: f"p{int(round(p * 100))}" for p in probs}
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    out = q.groupBy("column_name").agg(*[at(p).alias(a) for p, a in names.items()], (at(1.0) - at(0.0)).alias("range"))
    if 0.25 in names and 0.75 in names:
        out = out.withColumn("iqr", F.col("p75") - F.col("p25"))
    return out


def profile_categorical(df: DataFrame, cols: Sequence[str] | None = None, values: DataFrame | None = None) -> DataFrame:
    """(column_name, n, n_missing, n_distinct, min_length, mean_length, max_length), all from
    the value table and the number of rows."""
    cols = list(cols) if cols else string_columns(df)
    values = value_table(df, cols) if values is None else values
    spec = F.broadcast(df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string"))
    rows = df.count()
    size = F.length("value")
    out = spec.join(values.groupBy("column_name").agg(
        F.sum("count").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.min(size).cast("int").alias("min_length"),
        (F.sum(size * F.col("count")) / F.sum("count")).alias("mean_length"),
        F.max(size).cast("int").alias("max_length")), "column_name", "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return out.select("column_name", n.alias("n"), (F.lit(rows).cast("bigint") - n).alias("n_missing"),
                      F.coalesce(F.col("n_distinct"), F.lit(0)).cast("bigint").alias("n_distinct"),
                      "min_length", "mean_length", "max_length")


def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 5, buckets: int = 64,
               values: DataFrame | None = None) -> DataFrame:
    """(column_name, value, count, rank): the k most frequent non-null values of
    each column, ties by value.  Ranked first inside (column, hash bucket),
    then among the at most k x buckets survivors of each column."""
    cols = list(cols) if cols else string_columns(df)
    values = value_table(df, cols) if values is None else values.filter(F.col("column_name").isin(cols))
    counts = values.select("column_name", F.col("shown").alias("value"), "count")
    order = [F.col("count").desc(), F.col("value")]
    local = (counts.withColumn("_bk", F.pmod(F.xxhash64("value"), F.lit(buckets)))
             .withColumn("_r", F.row_number().over(Window.partitionBy("column_name", "_bk").orderBy(*order)))
             .filter(F.col("_r") <= k))
    final = local.withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy(*order)))
    return final.filter(F.col("rank") <= k).select("column_name", "value", "count",
                                                   F.col("rank").cast("int").alias("rank"))


def profile_missing(df: DataFrame) -> DataFrame:
    """(column_name, n_missing, pct_missing) for every column, one aggregate."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.sum(F.col(_q(c)).isNull().cast("int")).alias(f"m{i}") for i, c in enumerate(cols)])
    items = [F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").cast("bigint").alias("n_missing"),
                      F.when(F.col("_rows") > 0, F.col(f"m{i}") / F.col("_rows")).alias("pct_missing"))
             for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*items)).alias("e")).select("e.*")


def profile_alerts(df: DataFrame, numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None,
                   skew_threshold: float = 20.0, zeros_threshold: float = 0.1,
                   imbalance_threshold: float = 0.5, values: DataFrame | None = None,
                   numeric_rows: DataFrame | None = None, categorical_rows: DataFrame | None = None) -> DataFrame:
    """(column_name, alert, value) from the profile rows:
    CONSTANT (one distinct value), MISSING (any missing, value = share),
    SKEWED (|skewness| > threshold), ZEROS (share of zeros > threshold),
    IMBALANCE (top value share > threshold, strings), DUPLICATES (table).
    What ``profile`` has computed already (the strings' value table and the rows of both
    sections, written) is passed in, else computed here."""
    nums = list(numeric) if numeric is not None else numeric_columns(df)
    cats = list(categorical) if categorical is not None else string_columns(df)
    if cats and values is None:
        values = value_table(df, cats)
    # a row for each column: written, so that the rules below do not repeat the passes
    num = numeric_rows if numeric_rows is not None else cut_lineage(_numeric_or_none(df, nums), "profile-numeric")
    cat = None
    if cats:
        cat = categorical_rows if categorical_rows is not None else cut_lineage(
            profile_categorical(df, cats, values=values), "profile-strings")
    rows = num.select("column_name", "n", "n_missing", "n_distinct", "n_zeros", "skewness")
    total = F.col("n") + F.col("n_missing")
    alerts = [
        rows.filter(F.col("n_distinct") == 1).select("column_name", F.lit("CONSTANT").alias("alert"),
                                                     F.lit(1.0).alias("value")),
        rows.filter(F.col("n_missing") > 0).select("column_name", F.lit("MISSING").alias("alert"),
                                                   F.try_divide(F.col("n_missing"), total).alias("value")),
        rows.filter(F.abs("skewness") > skew_threshold).select("column_name", F.lit("SKEWED").alias("alert"),
                                                               F.col("skewness").alias("value")),
        rows.filter(F.try_divide("n_zeros", "n") > zeros_threshold).select(
            "column_name", F.lit("ZEROS").alias("alert"), F.try_divide("n_zeros", "n").alias("value")),
    ]
    if cat is not None:
        c = cat.select("column_name", "n", "n_missing", "n_distinct")
        tot = F.col("n") + F.col("n_missing")
        alerts += [
            c.filter(F.col("n_distinct") == 1).select("column_name", F.lit("CONSTANT").alias("alert"),
                                                      F.lit(1.0).alias("value")),
            c.filter(F.col("n_missing") > 0).select("column_name", F.lit("MISSING").alias("alert"),
                                                    F.try_divide(F.col("n_missing"), tot).alias("value")),
        ]
        top = top_values(df, cats, k=1, values=values).join(c.select("column_name", "n"), "column_name")
        alerts.append(top.filter(F.try_divide("count", "n") > imbalance_threshold).select(
            "column_name", F.lit("IMBALANCE").alias("alert"), F.try_divide("count", "n").alias("value")))
    dup = clean.duplicate_count(df).filter(F.col("n_duplicates") > 0).select(
        F.lit("(table)").alias("column_name"), F.lit("DUPLICATES").alias("alert"),
        F.col("n_duplicates").cast("double").alias("value"))
    alerts.append(dup)
    out = alerts[0]
    for a in alerts[1:]:
        out = out.unionByName(a)
    return out


def _numeric_or_none(df: DataFrame, nums: Sequence[str]) -> DataFrame:
    """``profile_numeric``, without rows if there are no numeric columns."""
    if nums:
        return profile_numeric(df, nums)
    names = "n n_missing n_distinct n_zeros n_negative".split()
    return df.sparkSession.createDataFrame([], "column_name string, data_type string, " + ", ".join(
        [f"{c} bigint" for c in names] + [f"{c} double" for c in "min max mean std variance skewness kurtosis sum".split()]))


def profile(df: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    """All sections for all numeric and string columns: numeric, quantiles, categorical,
    top_values, missing, correlation, alerts.  Strings are counted in full once, for three
    sections; top values of numbers come from a sketch and a recount."""
    from .corr import correlation_matrix
    from .sketches import top_values_sketched
    # every section reads the rows: written once, in parts of equal size
    df = cut_lineage(df.hint("rebalance"), "profile-rows")
    nums, cats = numeric_columns(df), string_columns(df)
    values = value_table(df, cats) if cats else None
    number_rows = cut_lineage(_numeric_or_none(df, nums), "profile-numeric")
    string_rows = cut_lineage(profile_categorical(df, cats, values=values), "profile-strings") if cats else None
    out = {"missing": profile_missing(df),
           "alerts": profile_alerts(df, nums, cats, values=values, numeric_rows=number_rows, categorical_rows=string_rows)}
    tops = ([top_values_sketched(df, nums, k)] if nums else []) + ([top_values(df, cats, k, values=values)] if cats else [])
    if tops:
        out["top_values"] = tops[0] if len(tops) == 1 else tops[0].unionByName(tops[1])
    if nums:
        out |= {"numeric": number_rows, "quantiles": profile_quantiles(df, nums), "correlation": correlation_matrix(df, nums)}
    if cats:
        out["categorical"] = string_rows
    return out


def profile_long(df: DataFrame, k: int = 5) -> DataFrame:
    """(section, column_name, item, value): every number of ``profile`` in one table; item is
    the statistic, the other column of a correlation, or the rank of a top value."""
    parts = []
    for section, rows in profile(df, k).items():
        if section == "correlation":
            parts.append(rows.select(F.lit(section).alias("section"), F.col("feature_x").alias("column_name"),
                                     F.col("feature_y").alias("item"), F.col("correlation").alias("value")))
        elif section == "alerts":
            parts.append(rows.select(F.lit(section).alias("section"), "column_name", F.col("alert").alias("item"), "value"))
        elif section == "top_values":
            parts.append(rows.select(F.lit(section).alias("section"), "column_name",
                                     F.concat(F.col("rank").cast("string"), F.lit(":"), F.col("value")).alias("item"),
                                     F.col("count").cast("double").alias("value")))
        else:
            stats = [c for c, t in rows.dtypes if c != "column_name" and t != "string"]
            items = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in stats])
            parts.append(rows.select(F.lit(section).alias("section"), "column_name", F.explode(items).alias("e"))
                         .select("section", "column_name", "e.item", "e.value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
