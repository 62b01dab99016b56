"""Reproducible train/test split and fold assignment.

A row's side depends only on (seed, key): u = md5(seed|key) / 2^32, train
when u < fraction.  The result is the same for any partitioning and after
any task retry, unlike an unseeded ``randomSplit``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import md5_uniform
from ..session import cut_lineage


def assign_split(df: DataFrame, key: str, fraction: float = 0.7, seed: int = 0,
                 stratify: str | None = None, out: str = "split") -> DataFrame:
    """Add ``out`` = 'train' / 'test'.  With ``stratify`` each class gets exactly
    round(fraction * class size) train rows, the first in order of (u, key); rows
    without a label are a class of their own.  Once the cuts are known a row's side is
    a comparison with its class's cut."""
    u = md5_uniform(F.lit(str(seed)), F.col(key))
    if stratify is None:
        return df.withColumn(out, F.when(u < F.lit(fraction), "train").otherwise("test"))
    cuts = stratum_cuts(df.select(F.col(stratify).alias("_g"), F.col(key).alias("_k"), u.alias("_u")), fraction)
    d = df.withColumn("_u", u)
    j = d.join(cuts, d[stratify].eqNullSafe(cuts["_g"]), "left")
    train = F.struct("_u", F.col(key)) <= F.struct("_cut_u", "_cut_k")
    return (j.withColumn(out, F.when(F.col("_cut_u").isNotNull() & train, "train").otherwise("test"))
            .drop("_u", "_g", "_cut_u", "_cut_k"))


def stratum_cuts(keyed: DataFrame, fraction: float, rows_per_bucket: int = 50_000) -> DataFrame:
    """(_g, _cut_u, _cut_k): the last train row of each class (NULL is a class) in order of
    (u, key); a class without train rows has none.  Counts by (class, range of u) find the
    range of a class's cut; only the rows of that range are ranked."""
    n = keyed.count()
    buckets = max(1, -(-n // rows_per_bucket))
    bucket = F.least(F.floor(F.col("_u") * buckets), F.lit(buckets - 1)).alias("_b")
    cells = cut_lineage(keyed.groupBy("_g", bucket).agg(F.count(F.lit(1)).alias("_c")), "split-cells")
    by_class = Window.partitionBy("_g")
    cum = cells.select("_g", "_b", "_c", F.sum("_c").over(by_class.orderBy("_b")).alias("_to"),
                       F.round(F.sum("_c").over(by_class) * F.lit(fraction)).cast("bigint").alias("_want"))
    at = cum.filter((F.col("_to") - F.col("_c") < F.col("_want")) & (F.col("_want") <= F.col("_to"))).select(
        F.col("_g").alias("_ag"), F.col("_b").alias("_ab"), (F.col("_want") - F.col("_to") + F.col("_c")).alias("_nth"))
    inside = keyed.withColumn("_b", bucket)
    inside = inside.join(at, inside["_g"].eqNullSafe(at["_ag"]) & (inside["_b"] == at["_ab"]))
    ranked = inside.withColumn("_r", F.row_number().over(by_class.orderBy("_u", "_k")))
    return cut_lineage(ranked.filter(F.col("_r") == F.col("_nth")).select(
        "_g", F.col("_u").alias("_cut_u"), F.col("_k").alias("_cut_k")), "split-cuts")


def split(df: DataFrame, key: str, fraction: float = 0.7, seed: int = 0,
          stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    s = assign_split(df, key, fraction, seed, stratify, "_split")
    return (s.filter(F.col("_split") == "train").drop("_split"),
            s.filter(F.col("_split") == "test").drop("_split"))


def assign_folds(df: DataFrame, key: str, folds: int = 3, seed: int = 0, out: str = "fold") -> DataFrame:
    """Fold number in [0, folds) from the key hash (for CrossValidator's foldCol)."""
    u = md5_uniform(F.lit(f"fold{seed}"), F.col(key))
    return df.withColumn(out, F.least(F.floor(u * folds), F.lit(folds - 1)).cast("int"))
