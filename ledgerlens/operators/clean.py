"""Filters, nulls and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_rows(df: DataFrame, label: str, value) -> DataFrame:
    """Rows of one class (pushed down to the Parquet scan when possible)."""
    return df.filter(F.col(label) == F.lit(value))


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(n_rows, n_distinct, n_duplicates) in one job: count() - distinct().count().

    The group-by is map-side combined, so a value repeated by a third of the
    rows collapses before the shuffle."""
    cols = list(cols) if cols else df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("n_rows"),
                 F.count(F.lit(1)).cast("bigint").alias("n_distinct"),
                 F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=list(subset) if subset else None)


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None,
                    keep_by: str | None = None) -> DataFrame:
    """Drop rows equal on ``subset`` (default: all columns but ``keep_by``).

    With ``keep_by`` the survivor of each group is the row with the smallest
    ``keep_by`` (deterministic, unlike ``dropDuplicates``); NULLs compare equal."""
    if keep_by is None:
        return df.dropDuplicates(list(subset) if subset else None)
    subset = list(subset) if subset else [c for c in df.columns if c != keep_by]
    others = [c for c in df.columns if c not in subset and c != keep_by]
    aggs = [F.min(keep_by).alias(keep_by)]
    aggs += [F.min_by(F.col(c), F.col(keep_by)).alias(c) for c in others]
    return df.groupBy(*subset).agg(*aggs).select(*df.columns)
