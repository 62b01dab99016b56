"""Running sums in a global order without an unbounded single-task window.

``Window.orderBy(x)`` with no ``partitionBy`` moves every row into one task.
Instead the order is cut into ``nb`` contiguous ranges, the window runs per
range, and each range's total becomes an offset for the ranges after it.
``nb`` grows with the table: a range holds at most ROWS_PER_RANGE rows.
How a row finds its range depends on ``nb``:

* ``nb == 1`` (at most MIN_ROWS_PER_RANGE rows, counted): one window task.
* ``nb <= LITERAL_RANGES``: boundaries from a bounded sample (about 64 rows
  per range, what Spark's range partitioner does) are baked into the plan as
  literals and found by a binary-search CASE of depth log2(nb).  A recomputed
  task puts every row in the same range again; the range totals (``nb`` rows)
  come to the driver and go back as a literal array.
* larger ``nb`` (a big table on a big cluster): Spark's own range partitioner
  (``repartitionByRange``: sampled bounds, binary search in the JVM) cuts
  the order, ``spark_partition_id()`` names the range, and the per-range
  result is written once into the shared checkpoint folder, which fixes the
  range of every row.  Range totals turn into offsets through a window over
  at most ``nb`` rows, joined back as a broadcast of that bounded size.  The
  expression size stays constant however many ranges there are.

Order keys must be non-null and the order tuple unique (end it with a key
column), so that no single value can fill one range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .exprs import search_bucket

BUCKET_COL = "_bucket"
ROWS_PER_RANGE = 2_000_000   # upper bound of rows sorted by one window task
MIN_ROWS_PER_RANGE = 10_000  # small tables get fewer, fuller ranges
LITERAL_RANGES = 64          # above this, ranges come from Spark's range partitioner


def range_count(spark, n: int, buckets: int | None = None) -> int:
    """Number of ranges: ``buckets`` if given, else enough that a range holds at
    most ROWS_PER_RANGE rows, and up to the shuffle partition count while each
    range still gets MIN_ROWS_PER_RANGE rows."""
    if buckets:
        return max(1, int(buckets))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    by_size = -(-n // ROWS_PER_RANGE)
    by_parts = min(parts, -(-n // MIN_ROWS_PER_RANGE))
    return max(1, by_size, by_parts)


def range_bounds(df: DataFrame, keys: Sequence[str], buckets: int, n: int, seed: int = 11) -> list[tuple]:
    """Up to ``buckets - 1`` sorted boundaries of the key tuple, from a sample
    of about 64 rows per range (bounded by LITERAL_RANGES; never the table)."""
    if buckets <= 1 or n == 0:
        return []
    frac = min(1.0, 64.0 * buckets / n)
    sample = df.select(*keys)
    for k in keys:
        sample = sample.filter(F.col(k).isNotNull())
    # numbers and UTF-8 strings order the same way in Python and Spark; NaN,
    # which Spark puts last, too
    rows = [tuple(r) for r in sample.sample(False, frac, seed=seed).collect()]
    if not rows:
        return []
    rows.sort(key=lambda t: tuple((1, 0.0) if isinstance(v, float) and math.isnan(v) else (0, v) for v in t))
    picks: list[tuple] = []
    for i in range(1, buckets):
        t = tuple(rows[min(len(rows) - 1, (len(rows) * i) // buckets)])
        if not picks or picks[-1] != t:
            picks.append(t)
    return picks


def _sum_type(df: DataFrame, c: str) -> str:
    t = df.schema[c].dataType.simpleString()
    return "double" if t in ("float", "double") or t.startswith("decimal") else "bigint"


def _literal_ranges(df: DataFrame, keys: list[str], sum_cols: Sequence[str], prefix: str,
                    nb: int, n: int) -> DataFrame:
    bounds = range_bounds(df, keys, nb, n)
    if bounds:
        types = [df.schema[k].dataType.simpleString() for k in keys]
        b = df.withColumn(BUCKET_COL, search_bucket([F.col(k) for k in keys], bounds, types, names=keys))
    else:
        b = df.withColumn(BUCKET_COL, F.lit(0))
    n_ranges = len(bounds) + 1
    offset_cols = {}
    if n_ranges > 1:
        totals = {r[BUCKET_COL]: r for r in
                  b.groupBy(BUCKET_COL).agg(*[F.sum(c).alias(c) for c in sum_cols]).collect()}
        for c in sum_cols:
            acc, offs = 0, []
            for i in range(n_ranges):
                offs.append(acc)
                r = totals.get(i)
                if r is not None and r[c] is not None:
                    acc += r[c]
            arr = "array(" + ", ".join(f"CAST({o!r} AS {_sum_type(df, c)})" for o in offs) + ")"
            offset_cols[c] = F.expr(f"element_at({arr}, {BUCKET_COL} + 1)")
    # with one range this is a single window task over at most MIN_ROWS_PER_RANGE rows
    w = (Window.partitionBy(BUCKET_COL).orderBy(*keys)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return b.select(*[F.col(c) for c in df.columns],
                    *[(F.sum(c).over(w) + offset_cols[c] if c in offset_cols else F.sum(c).over(w))
                      .alias(prefix + c) for c in sum_cols])


def _partitioner_ranges(df: DataFrame, keys: list[str], sum_cols: Sequence[str], prefix: str,
                        nb: int) -> DataFrame:
    ranged = df.repartitionByRange(nb, *keys).withColumn(BUCKET_COL, F.spark_partition_id())
    w = (Window.partitionBy(BUCKET_COL).orderBy(*keys)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # rows of one range sit in one task; hash on the range id (nb ways) satisfies the window
    local = ranged.repartition(nb, BUCKET_COL).select(
        "*", *[F.sum(c).over(w).alias("_loc_" + c) for c in sum_cols])
    local = cut_lineage(local, "running-sums")
    totals = local.groupBy(BUCKET_COL).agg(*[F.sum(c).alias("_t_" + c) for c in sum_cols])
    before = Window.orderBy(BUCKET_COL).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(BUCKET_COL, *[F.coalesce(F.sum("_t_" + c).over(before), F.lit(0)).alias("_o_" + c)
                                          for c in sum_cols])
    # one row per range: bounded by nb
    return local.join(F.broadcast(offsets), BUCKET_COL).select(
        *[F.col(c) for c in df.columns],
        *[(F.col("_loc_" + c) + F.col("_o_" + c)).alias(prefix + c) for c in sum_cols])


def running_sums(df: DataFrame, order_cols: Sequence[str], sum_cols: Sequence[str], *,
                 partition_cols: Sequence[str] = (), prefix: str = "cum_",
                 buckets: int | None = None, n: int | None = None) -> DataFrame:
    """Add ``prefix + c`` = inclusive running sum of ``c`` in ascending
    (partition_cols, order_cols) order; restarts at each partition value."""
    spark = df.sparkSession
    keys = list(partition_cols) + list(order_cols)
    if n is None:
        n = df.count()
    nb = range_count(spark, n, buckets)
    if nb <= LITERAL_RANGES:
        out = _literal_ranges(df, keys, sum_cols, prefix, nb, n)
    else:
        out = _partitioner_ranges(df, keys, sum_cols, prefix, nb)

    if partition_cols:
        # restart per partition: subtract the total of all earlier partitions,
        # a running sum over the per-partition totals (one row per partition
        # value), so the window above runs once
        ptot = df.groupBy(*partition_cols).agg(*[F.sum(c).alias(c) for c in sum_cols])
        pcum = running_sums(ptot, list(partition_cols), sum_cols, prefix="_pc_")
        base = pcum.select(*partition_cols, *[(F.col("_pc_" + c) - F.col(c)).alias("_base_" + c)
                                              for c in sum_cols])
        out = out.join(base, list(partition_cols), "inner")
        out = out.select(
            *[F.col(c) for c in df.columns],
            *[(F.col(prefix + c) - F.col("_base_" + c)).alias(prefix + c) for c in sum_cols])
    return out


def global_rank(df: DataFrame, order_cols: Sequence[str], out: str = "rank", *,
                partition_cols: Sequence[str] = (), buckets: int | None = None,
                n: int | None = None) -> DataFrame:
    """1-based row number in (partition_cols, order_cols) order, distributed."""
    one = "_one"
    ranked = running_sums(df.withColumn(one, F.lit(1).cast("bigint")), order_cols, [one],
                          partition_cols=partition_cols, prefix="_cum", buckets=buckets, n=n)
    return ranked.withColumnRenamed("_cum" + one, out).drop(one)
