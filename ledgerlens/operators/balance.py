"""Class balancing.

Random streams of the reference (``sample(withReplacement)``, imblearn's
generator) cannot be reproduced on a cluster, so the default modes are
hash-driven: every random choice is md5(seed|tag|id) / 2^32, which is the
same for any partitioning and after any task retry.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import md5_int, md5_uniform, poisson_count
from ..functions.prefix import global_rank
from . import clean
from .knn import knn_tables, knn_within
from ..session import cut_lineage


def class_counts(df: DataFrame, label: str, minority=1) -> tuple[int, int]:
    """(n_majority, n_minority) in one aggregate (two scalars to the driver); rows without
    a label are in neither class."""
    r = df.agg(F.sum(F.when(F.col(label) != minority, 1).otherwise(0)).alias("maj"),
               F.sum(F.when(F.col(label) == minority, 1).otherwise(0)).alias("mino")).first()
    return int(r["maj"] or 0), int(r["mino"] or 0)


# ---------------------------------------------------------------- B1
def oversample_minority(df: DataFrame, label: str, key: str, ratio: float = 1.0, minority=1,
                        mode: str = "replicate", seed: int = 88, copy_col: str | None = "copy") -> DataFrame:
    """Grow the minority to majority:minority = ``ratio``:1.

    ``replicate``: each minority row gets floor(r) copies plus one more when
    its key hash falls below frac(r), r = (maj/min)/ratio: exact expected size,
    deterministic.  ``random``: a bootstrap, each minority row comes Poisson(r) times,
    none included, as sampling with replacement gives it on a large table; the number is
    the inverse distribution at the key's hash, so reruns and any partitioning agree.
    Rows that share a key share their number.  When the classes already meet the ratio nothing is sampled (the reference
    says so but samples anyway)."""
    maj, mino = class_counts(df, label, minority)
    is_min = F.col(label) == minority
    base = df.withColumn(copy_col, F.lit(1)) if copy_col else df
    if mino == 0 or maj / mino <= ratio:
        return base
    r = (maj / mino) / ratio
    majority = df.filter(~is_min | F.col(label).isNull())
    minority_rows = df.filter(is_min)
    if mode == "random":
        n_copies = poisson_count(r, F.lit(str(seed)), F.lit("p"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    elif mode == "replicate":
        whole = math.floor(r)
        draw = md5_uniform(F.lit(str(seed)), F.lit("r"), F.col(key))
        n_copies = F.lit(whole) + F.when(draw < F.lit(r - whole), 1).otherwise(0)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    copies = F.when(n_copies > 0, F.sequence(F.lit(1), n_copies))      # explode drops rows without copies
    grown = minority_rows.withColumn("_copy", F.explode(copies))
    grown = grown.withColumnRenamed("_copy", copy_col) if copy_col else grown.drop("_copy")
    if copy_col:
        majority = majority.withColumn(copy_col, F.lit(1))
    return majority.unionByName(grown)


# ---------------------------------------------------------------- B2 B3
def smote(df: DataFrame, label: str, features: Sequence[str], key: str, k: int = 5, seed: int = 42,
          minority=1, n_new: int | None = None, int_cols: Sequence[str] = (),
          id_col: str = "synthetic_id", first_id: int = 0,
          categorical: Sequence[str | Sequence[str]] = (), max_categories: int = 1000,
          strategy: str = "exact") -> DataFrame:
    """Synthetic minority rows: new = base + u * (neighbour - base).

    For synthetic row i (i = 0 .. n_new-1): base = minority row number
    md5(seed|b|i) mod n_min (60 bits of the hash) in key order, neighbour = its
    (md5(seed|k|i) mod k + 1)-th nearest minority row, u = md5(seed|g|i)/2^32.
    ``int_cols`` are truncated back to integers (the reference's dtype cast).
    Default ``n_new`` = majority - minority.  Output: id, features, label.

    ``categorical`` names features that are categories: a column of any type, or a group
    of one-hot columns.  Neighbours are then nearest in the mixed distance: the squared
    differences of the numeric features plus, for each category that differs, the square of
    the median of the numeric features' standard deviations (of the minority rows).  A
    synthetic row takes the commonest category among the k neighbours of its base (ties:
    the smallest label, null last), so a one-hot group keeps exactly one 1 where its rows
    have one.  A null category, or a group without a 1, is a category of its own.  At least
    one feature is numeric; more than ``max_categories`` labels in a column raise.

    ``strategy="approximate"`` takes neighbours from ``knn.knn_approximate``."""
    features = list(features)
    cats = _categories(features, categorical)
    taken = {c for _, cols in cats for c in cols}
    numeric = [f for f in features if f not in taken]
    if cats and not numeric:
        raise ValueError("at least one feature must be numeric")
    spark = df.sparkSession
    maj, n_min = class_counts(df, label, minority)
    if n_new is None:
        n_new = max(0, maj - n_min)
    out_schema = [F.col(id_col)] + [F.col(f) for f in features] + [F.col(label)]
    kk = min(k, n_min - 1)
    if n_new <= 0 or kk < 1:
        empty = spark.range(0).select(F.col("id").alias(id_col),
                                      *[F.lit(None).cast(df.schema[f].dataType).alias(f) for f in features],
                                      F.lit(minority).cast(df.schema[label].dataType).alias(label))
        return empty.select(*out_schema)
    names = [f"_cat{i}" for i in range(len(cats))]
    mino = df.filter(F.col(label) == minority).select(
        key, *numeric, *[_category(cols, group).alias(a) for (group, cols), a in zip(cats, names)])
    mino = cut_lineage(mino, "smote-minority")  # read the (large) input once
    points, axes = (mino, numeric) if not cats else _with_penalties(mino, numeric, names, max_categories)
    if strategy == "exact":
        # minority row number in key order, ranked in the same pass as the kNN axes
        nbrs, pts = knn_tables(points, key, axes, kk, key_rank=True)
        idx = pts.select(F.col("_krank").alias("_kidx"), F.col("_key").alias(key), *numeric)
    else:
        nbrs = cut_lineage(knn_within(points, key, axes, kk, strategy=strategy), "smote-nearest")
        idx = cut_lineage(global_rank(mino.select(key, *numeric), [key], "_kidx", n=n_min), "smote-ranked")
    s = str(seed)
    i = F.col("id")
    gen = spark.range(n_new).select(
        (i + F.lit(first_id)).alias(id_col),
        (md5_int(F.lit(s), F.lit("b"), i, digits=15) % n_min + 1).alias("_kidx"),
        (md5_int(F.lit(s), F.lit("k"), i, digits=15) % kk + 1).cast("int").alias("neighbor_rank"),
        md5_uniform(F.lit(s), F.lit("g"), i).alias("_u"))
    # one row for each (base, neighbour), n_min * k of them, with both feature sets; the
    # generated rows, about as many as the majority, are joined once
    both = (nbrs.select(F.col(key).alias("_base"), "neighbor_rank", "neighbor_key")
            .join(idx.select("_kidx", F.col(key).alias("_base"), *[F.col(f).alias(f"_b_{f}") for f in numeric]), "_base")
            .join(mino.select(F.col(key).alias("neighbor_key"), *[F.col(f).alias(f"_n_{f}") for f in numeric], *names),
                  "neighbor_key"))
    if cats:
        # at most k rows for each base
        votes = both.groupBy("_base").agg(F.collect_list(F.struct(*names)).alias("v")).select(
            "_base", *[_commonest(a).alias(a) for a in names])
        both = both.drop(*names).join(votes, "_base")
    both = cut_lineage(both.drop("_base", "neighbor_key"), "smote-neighbours")
    full = gen.join(both, ["_kidx", "neighbor_rank"])
    made = {}
    for f in numeric:
        b, n_ = F.col(f"_b_{f}").cast("double"), F.col(f"_n_{f}").cast("double")
        v = b + F.col("_u") * (n_ - b)
        if f in int_cols:
            v = v.cast(df.schema[f].dataType)
        made[f] = v.alias(f)
    for (group, cols), a in zip(cats, names):
        for c in cols:
            v = F.coalesce(F.col(a) == F.lit(c), F.lit(False)).cast("int") if group else F.col(a)
            made[c] = v.cast(df.schema[c].dataType).alias(c)
    return full.select(F.col(id_col), *[made[f] for f in features],
                       F.lit(minority).cast(df.schema[label].dataType).alias(label))


def _categories(features: Sequence[str], categorical) -> list[tuple[bool, list[str]]]:
    """(is a one-hot group, columns) of each category; columns must be features, once each."""
    cats = [(False, [c]) if isinstance(c, str) else (True, list(c)) for c in categorical]
    cols = [c for _, own in cats for c in own]
    wrong = [c for c in cols if c not in features or cols.count(c) > 1]
    if wrong:
        raise ValueError(f"categorical columns must be features, each once: {sorted(set(wrong))}")
    return cats


def _category(cols: Sequence[str], group: bool) -> Column:
    """A category as text: the column's value, or the name of the group's column that holds 1."""
    if not group:
        return F.col(cols[0]).cast("string")
    return F.coalesce(*[F.when(F.col(c) == 1, F.lit(c)) for c in cols])


def _commonest(name: str) -> Column:
    """The commonest value of field ``name`` in the array ``v``; ties: smallest, null last."""
    values = F.transform("v", lambda x: x[name])
    votes = F.transform(F.array_distinct(values), lambda x: F.struct(
        (-F.size(F.filter(values, lambda y: y.eqNullSafe(x)))).alias("n"), x.isNull().alias("none"), x.alias("value")))
    return F.array_min(votes)["value"]


def _with_penalties(mino: DataFrame, numeric: Sequence[str], names: Sequence[str],
                    max_categories: int) -> tuple[DataFrame, list[str]]:
    """``mino`` with one column for each label of each category, so that two rows with
    different labels are a squared median deviation further apart; and all axes."""
    row = mino.agg(*[F.stddev_pop(F.col(f).cast("double")).alias(f"s{i}") for i, f in enumerate(numeric)],
                   *[F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(names)]).first()
    wide = [i for i in range(len(names)) if row[f"d{i}"] > max_categories]
    if wide:
        raise ValueError(f"a categorical feature has {max(row[f'd{i}'] for i in wide)} labels, more than max_categories = "
                         f"{max_categories}")
    penalty = statistics.median([row[f"s{i}"] or 0.0 for i in range(len(numeric))]) / math.sqrt(2)
    axes, cols = [], []
    for a in names:     # at most max_categories labels, and null
        labels = sorted((r[0] for r in mino.select(a).distinct().collect()), key=lambda v: (v is None, v or ""))
        for i, value in enumerate(labels):
            axes.append(f"{a}_{i}")
            cols.append(F.when(F.col(a).eqNullSafe(F.lit(value)), F.lit(penalty)).otherwise(F.lit(0.0)).alias(axes[-1]))
    return mino.select("*", *cols), [*numeric, *axes]


# ---------------------------------------------------------------- B4 B5
def balance(df: DataFrame, label: str, features: Sequence[str], key: str, rounds: int = 1,
            dedupe: bool = True, k: int = 5, seed: int = 42, minority=1,
            int_cols: Sequence[str] = (), categorical: Sequence[str | Sequence[str]] = ()) -> DataFrame:
    """SMOTE, union with the originals, optional dedupe (the reference does two
    rounds, ``rounds=2``).  Synthetic rows get keys above the largest key; ``categorical``
    as in ``smote``."""
    cur = df.select(key, *features, label)
    for r in range(rounds):
        max_key = cur.agg(F.max(key)).first()[0] or 0
        syn = smote(cur, label, features, key, k=k, seed=seed + r, minority=minority,
                    int_cols=int_cols, id_col=key, first_id=int(max_key) + 1, categorical=categorical)
        cur = cur.unionByName(syn.select(key, *features, label))
        if dedupe:
            cur = clean.drop_duplicates(cur, keep_by=key)
    return cur
