"""Projection, scalar and feature operators.

The string index joins the ranked table of labels, so it takes any number of
them.  The encoders that add a column (or vector slot) per label fetch the label
list, which is as wide as their result; ``max_categories`` makes a longer one an
error, ``None`` sets no limit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import pair_code as _pair_code_expr

# ---------------------------------------------------------------- P1 P3 P4
def pair_code(df: DataFrame, a: str = "nameOrig", b: str = "nameDest", out: str = "type2") -> DataFrame:
    """First character of ``a`` then first character of ``b`` (null if either is null)."""
    return df.withColumn(out, _pair_code_expr(a, b))


def drop_columns(df: DataFrame, cols: Sequence[str], strict: bool = False) -> DataFrame:
    """Drop columns; missing names are ignored unless ``strict`` (pandas behaviour)."""
    if strict:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


_INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns in one projection.  A string holding a decimal ('9839.64')
    cast to an integral type goes through double and truncates (9839), which
    also works under ANSI mode."""
    current = dict(df.dtypes)
    out = []
    for c in df.columns:
        if c in types:
            t = types[c]
            e = F.col(c)
            if current[c] == "string" and t in _INTEGRAL:
                e = e.cast("double")
            out.append(e.cast(t).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# ---------------------------------------------------------------- P8
def category_counts(df: DataFrame, col: str) -> DataFrame:
    """(label, count) of the non-null labels of ``col``."""
    return (df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("label"))
              .agg(F.count(F.lit(1)).alias("count")))


MAX_CATEGORIES = 10_000     # labels that become columns: the width of the result


def fit_categories(df: DataFrame, col: str, order: str = "frequencyDesc",
                   max_categories: int | None = MAX_CATEGORIES) -> list[str]:
    """Labels of ``col`` in index order.  ``frequencyDesc`` = most frequent
    first, ties alphabetical (StringIndexer's order); ``alphabetAsc`` =
    sorted (pandas ``get_dummies`` order).  More than ``max_categories``
    labels raise before any is collected (None: no limit); nothing is left out."""
    counts = category_counts(df, col)
    if order == "frequencyDesc":
        counts = counts.orderBy(F.col("count").desc(), F.col("label").asc())
    elif order == "alphabetAsc":
        counts = counts.orderBy(F.col("label").asc())
    else:
        raise ValueError(f"unknown order {order!r}")
    if max_categories is not None:
        # the first labels, in one job for columns within the limit
        rows = counts.limit(max_categories + 1).collect()
        if len(rows) > max_categories:
            raise ValueError(f"column {col!r} has {category_counts(df, col).count()} categories, more than "
                             f"max_categories = {max_categories}")
    else:
        rows = counts.collect()
    return [r["label"] for r in rows]


def _free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that the table does not have."""
    have = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(have) + 2))) if n.lower() not in have)


def _check_new(df_columns: Sequence[str], new: Sequence[str]) -> None:
    """Raise on result columns that would exist twice."""
    every = [c.lower() for c in (*df_columns, *new)]
    twice = sorted({c for c in new if every.count(c.lower()) > 1})
    if twice:
        raise ValueError(f"columns exist already: {twice}")


def category_index_table(df: DataFrame, col: str) -> DataFrame:
    """(label, count, index) with StringIndexer's frequencyDesc order, as a
    DataFrame (for reports).  The category table is ranked with distributed
    running counts, so a column with very many labels never lands in one task."""
    from ..functions.prefix import global_rank
    counts = category_counts(df, col).withColumn("_negc", -F.col("count"))
    ranked = global_rank(counts, ["_negc", "label"], "_r")
    return ranked.select(F.col("label").alias(col), "count",
                         (F.col("_r") - 1).cast("double").alias(f"{col}_index"))


def string_index(df: DataFrame, col: str, out: str | None = None, labels: Sequence[str] | None = None,
                 handle_invalid: str = "error") -> DataFrame:
    """Label -> double index by descending frequency (StringIndexer semantics), by a
    join with the table of labels (fitted on ``df``, or the list given).  NULL and unseen
    labels raise; ``keep`` gives them the number of labels, ``skip`` drops their rows."""
    out = out or f"{col}_index"
    label, index = _free_name(df, "_si_label"), _free_name(df, "_si_index")
    if labels is None:
        table = category_index_table(df, col).select(F.col(col).alias(label), F.col(f"{col}_index").alias(index))
    else:
        table = df.sparkSession.createDataFrame(
            [(lab, float(i)) for i, lab in enumerate(labels)],
            T.StructType([T.StructField(label, df.schema[col].dataType), T.StructField(index, T.DoubleType())]))
    res = df.join(table, F.col(col) == F.col(label), "inner" if handle_invalid == "skip" else "left")
    found = F.col(index)
    if handle_invalid == "keep":
        found = F.coalesce(found, F.lit(float(table.count() if labels is None else len(labels))))
    elif handle_invalid != "skip":
        found = F.coalesce(found, F.raise_error(F.concat(
            F.lit(f"unseen label in {col}: "), F.coalesce(F.col(col).cast("string"), F.lit("NULL")))).cast("double"))
    return res.withColumn(out, found).drop(label, index)


# ---------------------------------------------------------------- P9 P10 P11 P12
def one_hot_vector(df: DataFrame, col: str, out: str | None = None, labels: Sequence[str] | None = None,
                   as_array: bool = False, max_categories: int | None = MAX_CATEGORIES) -> DataFrame:
    """Index ``col`` then one-hot encode it as an ML vector, dropLast=False."""
    from pyspark.ml.feature import OneHotEncoder
    from pyspark.ml.functions import vector_to_array
    out = out or f"{col}_vec"
    labels = list(labels) if labels is not None else fit_categories(df, col, max_categories=max_categories)
    idx = f"_{col}_idx"
    indexed = string_index(df, col, idx, labels)
    enc = OneHotEncoder(inputCols=[idx], outputCols=[out], dropLast=False, handleInvalid="error")
    res = enc.fit(indexed).transform(indexed).drop(idx)
    if as_array:
        res = res.withColumn(out, vector_to_array(F.col(out)))
    return res


def one_hot_columns(df: DataFrame, col: str, labels: Sequence[str] | None = None,
                    prefix: str | None = None, dtype: str = "double",
                    max_categories: int | None = MAX_CATEGORIES) -> DataFrame:
    """One 0/1 column per label (named ``label`` or ``prefix_label``), no vector detour."""
    labels = list(labels) if labels is not None else fit_categories(df, col, max_categories=max_categories)
    c = F.col(col)
    new = [F.when(c == lab, 1).otherwise(0).cast(dtype).alias(f"{prefix}_{lab}" if prefix else lab)
           for lab in labels]
    _check_new(df.columns, [f"{prefix}_{lab}" if prefix else lab for lab in labels])
    return df.select("*", *new)


def get_dummies(df: DataFrame, cols: Sequence[str], categories: Mapping[str, Sequence[str]] | None = None,
                max_categories: int | None = MAX_CATEGORIES, dtype: str = "int", unseen: str = "error") -> DataFrame:
    """pandas ``get_dummies``: ``<col>_<label>`` int columns in sorted label
    order, appended after the other columns; originals removed; NULL -> all 0.
    A label that is not among the given ``categories`` raises (``unseen="zero"``: all 0)."""
    categories = dict(categories or {})
    keep = [F.col(c) for c in df.columns if c not in cols]
    new, names = [], []
    for c in cols:
        labels = categories.get(c)
        other = F.lit(0)
        if labels is None:
            labels = fit_categories(df, c, "alphabetAsc", max_categories)
        elif unseen == "error":
            other = F.when(F.col(c).isNull() | F.col(c).isin(list(labels)), 0).otherwise(
                F.raise_error(F.concat(F.lit(f"unseen label in {c}: "), F.col(c).cast("string"))).cast("int"))
        for lab in labels:
            new.append(F.when(F.col(c) == lab, 1).otherwise(other).cast(dtype).alias(f"{c}_{lab}"))
            names.append(f"{c}_{lab}")
    _check_new([c for c in df.columns if c not in cols], names)
    return df.select(*keep, *new)


# ---------------------------------------------------------------- P13
def assemble(df: DataFrame, cols: Sequence[str], out: str = "features", label: str | None = None,
             handle_invalid: str = "error") -> DataFrame:
    """VectorAssembler; refuses the label as a feature (it would leak)."""
    from pyspark.ml.feature import VectorAssembler
    if label is not None and label in cols:
        raise ValueError(f"label {label!r} must not be a feature")
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=handle_invalid).transform(df)


# ---------------------------------------------------------------- P14 P15
def preview(df: DataFrame, n: int = 20, order_by: Sequence[str] | str | None = None) -> DataFrame:
    """First ``n`` rows (by ``order_by`` if given: a top-n, not a full sort)."""
    if order_by:
        df = df.orderBy(*([order_by] if isinstance(order_by, str) else order_by))
    return df.limit(n)


def sample_rows(df: DataFrame, key: str, n: int = 4, seed: int = 0) -> DataFrame:
    """``n`` random rows: those with the smallest key hashes, alike on every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def describe_schema(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type, non_null) from one aggregate pass."""
    counts = df.agg(*[F.count(F.col(c)).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column_name"),
                     F.lit(t).alias("data_type"), F.col(f"_n{i}").alias("non_null"))
            for i, (c, t) in enumerate(df.dtypes)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
