"""k nearest neighbours inside one table, without emitting all pairs (B6).

Exact, the default:

0. Of rows with equal features only the k + 1 with the smallest keys can be neighbours of
   any row (ties go by key), so only these are candidates, however many rows are equal.
1. Pivots: a bounded sample of rows (the smallest key hashes, at most MAX_PIVOTS).  Every
   row belongs to the cell of its nearest pivot; a cell knows its radius.
2. Neighbouring cells form groups of at most about 1/TILES of all candidates (BLOCK rows at
   least, GROUP at most).  Each group is searched alone: the k-th best distance inside is an
   upper bound for the row's k-th neighbour.
3. By the triangle inequality all rows of a cell are at least (distance to its pivot -
   radius) away.  A row visits the cells whose bound does not exceed its own upper bound.  It
   moves once for each group with such cells, whatever their number; its visits meet the
   group in tasks of at most about ``visits`` rows.
4. A task compares the rows with each cell they visit by a matrix product, whose rounding
   errors are bounded; only pairs that it cannot exclude get their distance computed feature
   by feature.  At most k rows for each visitor are returned, and its best k over all groups
   are its neighbours.

So what moves between tasks is rows times visited groups (TILES of them until groups have
GROUP rows), never pairs; where nothing can be pruned (noise in many dimensions) every row
meets every candidate in a matrix product, but nothing is emitted for it.  Distances are
summed feature by feature from the left, so ties are exact and go by the neighbour's key.
Everything iterative is written to the shared checkpoint folder.

Approximate (``strategy="approximate"``), for many rows in many dimensions, where exact
bounds prune little: hash tables of random projections.  In each table a row's projections on
a few random directions, cut at quantiles of a bounded sample, name its cell; all tables are
cut as finely as makes a row's cell hold at most ``LEAF`` rows on average, so the work grows in
proportion to the rows.  A row is compared with its own cell and with the cells beyond its
nearest borders (the probes); all distances are exact, so whatever is found is ranked
rightly, and only rows in none of the visited cells can be missed.  Rows for which fewer than
k were found are searched again in coarser cells, in the end in all rows.  The sample of at
most ``SAMPLE`` rows sets the cuts only; every row is in every table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.prefix import global_rank
from ..session import cut_lineage

MAX_PIVOTS = 512
ROWS_PER_PIVOT = 256
BLOCK = 1024
VISITS = 4096
TILES = 48
GROUP = 1 << 15

# approximate search
LEAF = 512
TABLES = 6
DIRECTIONS = 3
PROBES = 3
FINE_BITS = 12
SAMPLE = 1 << 15


def knn_within(df: DataFrame, key: str, features: Sequence[str], k: int = 5, block: int = BLOCK,
               max_pivots: int = MAX_PIVOTS, strategy: str = "exact", **options) -> DataFrame:
    """(key, neighbor_rank, neighbor_key, distance): the k nearest other rows of
    each row in Euclidean distance over ``features``; ties by neighbour key.
    ``strategy="approximate"`` may miss some (options of ``knn_approximate``)."""
    if strategy == "approximate":
        return knn_approximate(df, key, features, k, block=block, **options)
    if strategy != "exact" or options:
        raise ValueError(f"unknown strategy {strategy!r} or options {sorted(options)}")
    return knn_tables(df, key, features, k, block, max_pivots)[0]


def knn_tables(df: DataFrame, key: str, features: Sequence[str], k: int = 5, block: int = BLOCK,
               max_pivots: int = MAX_PIVOTS, key_rank: bool = False, visits: int = VISITS):
    """(neighbours, points): the k-NN table and the written point table
    (``_key``, features as double, and with ``key_rank`` the 1-based row number in key
    order as ``_krank``)."""
    features = list(features)
    spark = df.sparkSession
    pts, n = _points(df, key, features)
    key_type = df.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, neighbor_rank int, neighbor_key {key_type}, distance double"
    if n == 0:
        return spark.createDataFrame([], schema), pts
    points = cut_lineage(global_rank(pts, ["_key"], "_krank", n=n), "knn-ranked") if key_rank else pts

    vectors = pts.select("_key", F.array(*features).alias("v"))
    # at most max_pivots rows, whatever the size of the table
    chosen = vectors.orderBy(F.xxhash64("_key"), "_key").limit(max(1, min(max_pivots, n // ROWS_PER_PIVOT)))
    pivots = np.array([r["v"] for r in chosen.collect()], dtype=np.float64).reshape(-1, len(features))
    assigned = cut_lineage(_cells(_candidates(vectors, k, n), pivots, key_type), "knn-assigned")
    cells = assigned.filter("candidate")
    sizes = {r["cell"]: (r["n"], r["radius"]) for r in
             cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}
    tile = lambda least: max(least, min(GROUP, n // TILES))
    groups = _cell_groups(pivots, sizes, tile(block))
    table = spark.createDataFrame([(c, g, -(-sizes[c][0] // GROUP)) for c, g in groups.items()], "cell int, grp int, blocks int")
    # one row for each cell: at most max_pivots; a cell beyond GROUP rows is cut by key hash
    cells = cells.join(F.broadcast(table), "cell").withColumn("block", F.pmod(F.xxhash64("_key"), F.col("blocks")).cast("int"))
    cells = cut_lineage(cells.select("grp", "block", "cell", "_key", "v"), "knn-cells")

    # k other rows equal a row that is no candidate
    rest = assigned.filter("NOT candidate").select("_key", "v", F.lit(0.0).alias("tau"))
    bounded = cut_lineage(_upper_bounds(cells, k, key_type, ["grp", "block"]).unionByName(rest), "knn-bounds")
    asked = cut_lineage(_visits(bounded, pivots, sizes, groups, key_type), "knn-visits")
    load = asked.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / tile(visits)).cast("int").alias("parts"))
    most = table.groupBy("grp").agg(F.max("blocks").alias("blocks"))
    parts = cut_lineage(load.join(F.broadcast(most), "grp"), "knn-parts")       # one row for each group
    ask = asked.join(F.broadcast(parts), "grp").withColumn(
        "part", F.pmod(F.xxhash64("_key", F.lit(1)), F.col("parts")).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("grp", "block", "part", "_key", "v", "tau", "cells")
    have = cells.join(F.broadcast(parts.select("grp", "parts")), "grp").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("grp", "block", "part", "_key", "v", "cell")
    found = _meet(ask, have, k, key_type, ["grp", "block", "part"])
    order = Window.partitionBy("qk").orderBy("d2", "nk")
    top = cut_lineage(found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k), "knn-neighbours")
    return top.select(F.col("qk").alias(key), F.col("r").cast("int").alias("neighbor_rank"),
                      F.col("nk").alias("neighbor_key"), F.sqrt("d2").alias("distance")), points


def _points(df: DataFrame, key: str, features: list[str]) -> tuple[DataFrame, int]:
    """(written _key and features as doubles, number of rows); missing values raise."""
    pts = cut_lineage(df.select(F.col(key).alias("_key"),
                                *[F.col(f).cast("double").alias(f) for f in features]), "knn-points")
    stats = pts.agg(F.count(F.lit(1)).alias("n"), *[
        F.count(F.when(F.col(f).isNotNull() & ~F.isnan(f), 1)).alias(f"c{i}") for i, f in enumerate(features)]).first()
    empty = [f for i, f in enumerate(features) if stats[f"c{i}"] < stats["n"]]
    if empty:    # a distance to a missing value does not exist
        raise ValueError(f"NULL or NaN in features {empty}: drop or fill these rows first")
    return pts, int(stats["n"])


def knn_approximate(df: DataFrame, key: str, features: Sequence[str], k: int = 5, block: int = BLOCK, tables: int = TABLES,
                    directions: int = DIRECTIONS, probes: int = PROBES, leaf: int = LEAF, visits: int = VISITS,
                    seed: int = 0) -> DataFrame:
    """``knn_within`` by hash tables of random projections; rows and ranks as there, but a
    neighbour may be missed.  More tables, more probes or larger cells miss fewer."""
    features = list(features)
    spark = df.sparkSession
    pts, n = _points(df, key, features)
    key_type = df.schema[key].dataType.simpleString()
    if n == 0:
        return spark.createDataFrame([], f"{key} {key_type}, neighbor_rank int, neighbor_key {key_type}, distance double")
    want = min(k, n - 1)
    vectors = _candidates(pts.select("_key", F.array(*features).alias("v")), k, n)
    sample = pts.select(F.array(*features).alias("v")).orderBy(F.xxhash64("_key"), "_key").limit(min(SAMPLE, n)).collect()
    hashed = cut_lineage(_hashed(vectors, np.array([r["v"] for r in sample], dtype=np.float64), key_type, tables, directions,
                                 seed), "knn-hashed")
    level = _level(hashed, n, tables, leaf)
    queries, found = hashed, None
    while True:
        top = cut_lineage(_search(hashed, queries, level, tables, directions, probes, k, block, visits, key_type), "knn-found")
        enough = top.groupBy("qk").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= want).select(F.col("qk").alias("_key"))
        found = top.join(enough.withColumnRenamed("_key", "qk"), "qk", "left_semi") if found is None else found.unionByName(
            top.join(enough.withColumnRenamed("_key", "qk"), "qk", "left_semi"))
        if level == 0 or want == 0:
            break
        queries = cut_lineage(queries.join(enough, "_key", "left_anti"), "knn-short")
        if not queries.limit(1).count():
            break
        level = max(0, level - 2)
    return found.select(F.col("qk").alias(key), F.col("r").cast("int").alias("neighbor_rank"),
                        F.col("nk").alias("neighbor_key"), F.sqrt("d2").alias("distance"))


def _hashed(vectors: DataFrame, sample: np.ndarray, key_type: str, tables: int, directions: int, seed: int) -> DataFrame:
    """Adds fine: for each table and direction the row's place among 2^12 quantiles of the
    sample's projections (table-major)."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    lines = rng.standard_normal((tables * directions, d))
    share = np.arange(1, 1 << FINE_BITS) / (1 << FINE_BITS)
    edges = [np.quantile(_project(sample, line), share) for line in lines]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            v = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
            fine = np.stack([np.searchsorted(e, _project(v, line), side="right") for line, e in zip(lines, edges, strict=True)], axis=1)
            at = pa.array(np.arange(0, fine.size + 1, fine.shape[1]), pa.int32())
            yield pa.record_batch([*part.columns, pa.ListArray.from_arrays(at, pa.array(fine.ravel(), pa.int32()))],
                                  names=["_key", "v", "candidate", "fine"])
    return vectors.mapInArrow(run, f"_key {key_type}, v array<double>, candidate boolean, fine array<int>")


def _project(v: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Feature by feature from the left, so that equal rows have equal projections."""
    out = np.zeros(len(v))
    for f in range(len(line)):
        out += v[:, f] * line[f]
    return out


def _cell_sql(t: int, directions: int, level: int, moves: Sequence[int] = ()) -> str:
    """The cell of table ``t`` as SQL; directions in ``moves`` step over their nearer border."""
    shift = FINE_BITS - level
    parts = []
    for j in range(directions):
        q = f"fine[{t * directions + j}]"
        cell = f"shiftright({q}, {shift})"
        if j in moves:      # the border nearer to the row's place in its cell
            cell += f" + CASE WHEN ({q} & {(1 << shift) - 1}) * 2 < {(1 << shift) - 1} THEN -1 ELSE 1 END"
        parts.append(cell)
    return f"xxhash64({t}, {', '.join(parts)})"


def _level(hashed: DataFrame, n: int, tables: int, leaf: int) -> int:
    """The least number of halvings for which a row's cell holds ``leaf`` candidates on average."""
    directions = len(hashed.select("fine").first()["fine"]) // tables
    cells = hashed.filter("candidate")
    for level in range(FINE_BITS):
        codes = F.expr("array(" + ", ".join(_cell_sql(t, directions, level) for t in range(tables)) + ")")
        sizes = cells.select(F.explode(codes).alias("cell")).groupBy("cell").count()
        met, rows = sizes.agg(F.sum(F.col("count") * F.col("count")), F.sum("count")).first()
        if rows is None or met <= leaf * rows:
            return level
    return FINE_BITS


def _search(hashed: DataFrame, queries: DataFrame, level: int, tables: int, directions: int, probes: int, k: int, block: int,
            visits: int, key_type: str) -> DataFrame:
    """(qk, nk, d2, r): the best k rows that each query met in its cells."""
    if level == 0:
        tables, probes = 1, 0       # one cell holds all rows
    subsets = sorted((m for c in range(directions + 1) for m in itertools.combinations(range(directions), c)), key=len)
    cells = "array(" + ", ".join(f"named_struct('t', {t}, 'cell', {_cell_sql(t, directions, level)})" for t in range(tables)) + ")"
    own = hashed.filter("candidate").select("_key", "v", F.explode(F.expr(cells)).alias("c")).select("c.t", "c.cell", "_key", "v")
    sizes = cut_lineage(own.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "knn-cell-sizes")
    own = cut_lineage(own.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("_key"), F.col("blocks")).cast("int")),
                      "knn-cell-rows")
    # the first table's cells bound every row's k-th distance
    bounds = _upper_bounds(own.filter("t = 0").select("cell", "block", "_key", "v"), k, key_type, ["cell", "block"]).select("_key", "tau")
    asking = queries.join(bounds, "_key", "left").withColumn(
        "tau", F.when(F.col("candidate"), F.coalesce("tau", F.lit(float("inf")))).otherwise(F.lit(0.0)))
    met = "array(" + ", ".join(_cell_sql(t, directions, level, m) for t in range(tables) for m in subsets[:1 + probes]) + ")"
    asked = asking.select("_key", "v", "tau", F.explode(F.array_distinct(F.expr(met))).alias("cell"))
    asked = cut_lineage(asked.join(sizes, "cell"), "knn-asked")
    parts = cut_lineage(asked.groupBy("cell").agg(F.first("blocks").alias("blocks"), F.ceil(F.count(F.lit(1)) / visits)
                                                  .cast("int").alias("parts")), "knn-cell-parts")
    ask = asked.drop("blocks").join(parts, "cell").withColumn(
        "part", F.pmod(F.xxhash64("_key", F.lit(1)), F.col("parts")).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "part", "_key", "v", "tau")
    have = own.drop("blocks").join(parts, "cell").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "block", "part", "_key", "v")
    pairs = _meet(ask, have, k, key_type, ["cell", "block", "part"]).groupBy("qk", "nk").agg(F.min("d2").alias("d2"))
    order = Window.partitionBy("qk").orderBy("d2", "nk")
    return pairs.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)


def _candidates(vectors: DataFrame, k: int, n: int) -> DataFrame:
    """(_key, v, candidate): is the row's key among the k + 1 smallest of the rows with its
    features?  Ranked inside hash buckets first, so no task holds all equal rows."""
    buckets = max(64, n // 1_000_000)
    inside = Window.partitionBy("v", "b").orderBy("_key")
    first = vectors.withColumn("b", F.pmod(F.xxhash64("_key"), F.lit(buckets))).withColumn(
        "r", F.row_number().over(inside))
    few = first.filter(F.col("r") <= k + 1).withColumn("all", F.row_number().over(Window.partitionBy("v").orderBy("_key")))
    many = first.filter(F.col("r") > k + 1)
    return few.select("_key", "v", (F.col("all") <= k + 1).alias("candidate")).unionByName(
        many.select("_key", "v", F.lit(False).alias("candidate")))


def _cells(vectors: DataFrame, pivots: np.ndarray, key_type: str) -> DataFrame:
    """(cell, away, _key, v, candidate): each row's nearest pivot and its distance."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            v = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
            for at in range(0, len(v), 4096):
                some = v[at:at + 4096]
                d2 = np.zeros((len(some), len(pivots)))
                for f in range(v.shape[1]):
                    d = some[:, f, None] - pivots[None, :, f]
                    d2 += d * d
                cell = d2.argmin(axis=1)
                rows = part.slice(at, len(some))
                yield pa.record_batch([pa.array(cell, pa.int32()), pa.array(np.sqrt(d2[np.arange(len(some)), cell])),
                                       *rows.columns], names=["cell", "away", "_key", "v", "candidate"])
    return vectors.mapInArrow(run, f"cell int, away double, _key {key_type}, v array<double>, candidate boolean")


def _cell_groups(pivots: np.ndarray, sizes: dict[int, tuple[int, float]], rows: int) -> dict[int, int]:
    """The group of each cell: cells one after another, each the nearest to the one before,
    fill groups of about ``rows`` candidates."""
    left, groups, group, held = sorted(sizes), {}, 0, 0
    at = left[0]
    while left:
        near = ((pivots[left] - pivots[at]) ** 2).sum(axis=1)
        at = left.pop(int(near.argmin()))
        if held and held + sizes[at][0] > rows:
            group, held = group + 1, 0
        groups[at] = group
        held += sizes[at][0]
    return groups


def _vectors(table: pa.Table) -> np.ndarray:
    """Column ``v`` as a matrix."""
    v = table.column("v").combine_chunks()
    return v.flatten().to_numpy().reshape(len(v), -1)


class _Near:
    """Lower bounds of squared distances by one matrix product: |b|^2 - 2ab with the rounding
    errors of both, and of the distance itself, taken off; ``left`` also gives |a|^2.  Single
    precision serves where its errors are small beside the distances asked for."""

    def __init__(self, a: np.ndarray, b: np.ndarray, tau: np.ndarray):
        error = 4 * (a.shape[1] + 8) * np.finfo(np.float32).eps
        with np.errstate(over="ignore", invalid="ignore"):
            most = (a * a).sum(axis=1).max() + (b * b).sum(axis=1).max()
            self.type = np.float32 if most < 1e30 and error * most < 0.02 * np.median(tau) else np.float64
        self.slack = 1 - 4 * (a.shape[1] + 8) * np.finfo(self.type).eps

    def right(self, b: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.column_stack([b, (b * b).sum(axis=1) * self.slack]).T, dtype=self.type)

    def left(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.column_stack([-2.0 * a, np.ones(len(a))]).astype(self.type), (a * a).sum(axis=1) * self.slack


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` to those of ``b`` with the same number."""
    d2 = np.zeros(len(a))
    for f in range(a.shape[1]):
        d = a[:, f] - b[:, f]
        d2 += d * d
    return d2


def _upper_bounds(cells: DataFrame, k: int, key_type: str, by: Sequence[str]) -> DataFrame:
    """(_key, v, tau): a bound of the k-th smallest squared distance to the rows with the
    same values of ``by``."""
    def run(rows: pa.Table) -> pa.Table:
        v = _vectors(rows)
        tau = np.full(len(v), np.inf)
        if len(v) > k:
            near = _Near(v, v, np.array([np.inf]))     # any k rows give a bound
            product = near.right(v)
            step = max(1, 2_000_000 // len(v))
            for at in range(0, len(v), step):
                left, _ = near.left(v[at:at + step])
                low = left @ product
                i = np.arange(len(low))
                low[i, at + i] = np.inf
                # the distances of any k others bound the k-th
                some = np.argpartition(low, k - 1, axis=1)[:, :k]
                tau[at:at + step] = _squared(v[at + np.repeat(i, k)], v[some.ravel()]).reshape(-1, k).max(axis=1)
        tau[np.isnan(tau)] = np.inf
        return pa.table([rows.column("_key"), rows.column("v"), pa.array(tau)], names=["_key", "v", "tau"])
    return cells.groupBy(*by).applyInArrow(run, f"_key {key_type}, v array<double>, tau double")


def _visits(bounded: DataFrame, pivots: np.ndarray, sizes: dict[int, tuple[int, float]], groups: dict[int, int],
            key_type: str) -> DataFrame:
    """(grp, _key, v, tau, cells): for each group the cells that may hold a neighbour of the
    row, if any."""
    cells = np.array(sorted(sizes, key=lambda c: (groups[c], c)), dtype=np.int64)
    group = np.array([groups[c] for c in cells.tolist()])
    radius = np.array([sizes[c][1] for c in cells.tolist()])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            v = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
            tau = part.column(2).to_numpy()
            for at in range(0, len(v), 1024):
                some = v[at:at + 1024]
                d2 = np.zeros((len(some), len(cells)))
                for f in range(v.shape[1]):
                    d = some[:, f, None] - pivots[None, cells, f]
                    d2 += d * d
                near = np.sqrt(d2) - radius[None, :]
                # a little slack for rounding: it only adds visits
                row, cell = np.nonzero(near <= np.sqrt(tau[at:at + 1024])[:, None] * (1 + 1e-9) + 1e-9 * (1 + radius))
                if not len(row):
                    continue
                first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(group[cell]) != 0)])
                visited = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pa.array(cells[cell], pa.int32()))
                rows = part.slice(at, len(some)).take(pa.array(row[first]))
                yield pa.record_batch([pa.array(group[cell[first]], pa.int32()), *rows.columns, visited],
                                      names=["grp", "_key", "v", "tau", "cells"])
    return bounded.mapInArrow(run, f"grp int, _key {key_type}, v array<double>, tau double, cells array<int>")


def _meet(ask: DataFrame, have: DataFrame, k: int, key_type: str, by: Sequence[str]) -> DataFrame:
    """(qk, nk, d2): of the rows with the same values of ``by`` the best k of each row of
    ``ask``, if near enough.  Where ``have`` names its rows' cells, a row meets those in its
    ``cells`` only."""
    out = pa.schema([("qk", _arrow_type(have, "_key")), ("nk", _arrow_type(have, "_key")), ("d2", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        qk, nk = left.column("_key").combine_chunks(), right.column("_key").combine_chunks()
        codes = pa.chunked_array([qk, nk]).combine_chunks().dictionary_encode().indices.to_numpy()
        q_code, n_code = codes[:len(qk)], codes[len(qk):]
        place = np.empty(len(nk), dtype=np.int64)       # ties by key
        place[pc.sort_indices(nk).to_numpy()] = np.arange(len(nk))
        a, b, tau = _vectors(left), _vectors(right), left.column("tau").to_numpy()
        near = _Near(a, b, tau)
        product = near.right(b)
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        for some, many in _visited(left, right):
            own = product[:, many] if len(many) < len(nk) else product
            step = max(1, 500_000 // len(many))
            for at in range(0, len(some), step):
                i = some[at:at + step]
                ours, square = near.left(a[i])
                x, y = np.nonzero(ours @ own <= (tau[i] - square).astype(near.type)[:, None])
                i, j = i[x], many[y]
                other = q_code[i] != n_code[j]
                i, j = i[other], j[other]
                d2 = _squared(a[i], b[j])
                fine = (d2 <= tau[i]) & np.isfinite(d2)
                found.append(_best(i[fine], j[fine], d2[fine], place, k))
        i, j, d2 = _best(*(np.concatenate(x) for x in zip(*found, strict=True)), place, k)
        return pa.table([qk.take(pa.array(i)), nk.take(pa.array(j)), pa.array(d2)], schema=out)

    return ask.groupBy(*by).cogroup(have.groupBy(*by)).applyInArrow(run, f"qk {key_type}, nk {key_type}, d2 double")


def _best(i: np.ndarray, j: np.ndarray, d2: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row ``i`` the k pairs with the smallest distance, ties by place."""
    order = np.lexsort((place[j], d2, i))
    i, j, d2 = i[order], j[order], d2[order]
    first = np.flatnonzero(np.r_[True, np.diff(i) != 0][:len(i)])
    best = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
    return i[best], j[best], d2[best]


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def _visited(left: pa.Table, right: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``left``, rows of ``right``) that meet, cell by cell if cells are named."""
    if "cell" not in right.column_names or "cells" not in left.column_names:
        yield np.arange(left.num_rows), np.arange(right.num_rows)
        return
    cells = left.column("cells").combine_chunks()
    wanted = cells.flatten().to_numpy()
    owner = np.repeat(np.arange(len(cells)), pc.list_value_length(cells).to_numpy())
    by_cell = np.argsort(wanted, kind="stable")
    wanted, owner = wanted[by_cell], owner[by_cell]
    cell = right.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    found, first, sizes = np.unique(cell[order], return_index=True, return_counts=True)
    visits = np.searchsorted(wanted, found, side="right") - np.searchsorted(wanted, found)
    if 4 * int(visits @ sizes) > 3 * left.num_rows * right.num_rows:       # one product serves all
        yield np.arange(left.num_rows), np.arange(right.num_rows)
        return
    for c, many in zip(found, np.split(order, first[1:]), strict=True):
        some = owner[np.searchsorted(wanted, c):np.searchsorted(wanted, c, side="right")]
        if len(some):
            yield some, many
