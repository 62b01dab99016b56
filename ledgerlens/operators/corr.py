"""Correlation.

Pearson for all pairs: a mean pass, then one pass of centred plain sums
(few aggregation buffers, so the pass stays in whole-stage codegen); with
NULLs, pairwise deletion through covariance and masked deviations.  The
result is reshaped to long form; a constant column gives NULL, not an error.  Spearman = Pearson over average
ranks; ranks come from value counts and distributed running sums; they come
back as broadcasts for columns of few values, in one long join for all others.

Many columns (more than ``WIDE``) take another way: one aggregate for each pair would be a
plan of columns squared.  Each task adds up Gram matrices of its rows in numpy, one block of
columns against another, and emits one row for each pair of blocks; these partial sums are
added in groups of ``FAN_IN``, so no task reads more than that many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import field
from ..functions.prefix import running_sums
from ..session import cut_lineage


FEW_VALUES = 10_000     # distinct values of a column whose ranks are broadcast
HOT_PARTS = 1000


def average_ranks(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Replace each column by its average rank (1-based; ties share the mean).

    Value counts per (column, value) are written once (the raw rows are read once), running
    sums restart per column.  Ranks come back in two ways, by a column's number of distinct
    values: up to ``FEW_VALUES`` as a broadcast of that bounded size; all other columns
    together, as one join in long form.  Values that hold more than a thousandth of the long
    rows (fewer than 1,000) are broadcast too, so no task gets a hot value.  The rows are put
    together again by a row number.  NULL in any of these other columns drops the row."""
    cols = list(cols)
    number = {c: i for i, c in enumerate(cols)}
    arr = F.array(*[F.struct(F.lit(i).alias("_i"), field(c).cast("double").alias("_v")) for c, i in number.items()])
    counts = (df.select(F.explode(arr).alias("e")).select("e.*").filter(F.col("_v").isNotNull())
              .groupBy("_i", "_v").agg(F.count(F.lit(1)).alias("_c")))
    counts = cut_lineage(counts, "rank-counts")
    cum = running_sums(counts, ["_v"], ["_c"], partition_cols=["_i"])
    ranks = cut_lineage(cum.select("_i", "_v", "_c", (F.col("cum__c") - (F.col("_c") - 1) / 2.0).alias("_rank")), "ranks")
    size = {r["_i"]: (r["n"], r["rows"]) for r in ranks.groupBy("_i").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_c").alias("rows")).collect()}        # one row per column
    few = [c for c, i in number.items() if size.get(i, (0, 0))[0] <= FEW_VALUES]
    many = [c for c in cols if c not in few]
    out = df
    if many:
        rest = [c for c in df.columns if suffix or c not in many]
        kept = F.struct(*[field(c).alias(f"k{k}") for k, c in enumerate(rest)], F.lit(0).alias("_none"))
        rows = cut_lineage(df.select(F.monotonically_increasing_id().alias("_row"), kept.alias("_kept"), F.array(*[
            F.struct(F.lit(number[c]).alias("_i"), field(c).cast("double").alias("_v")) for c in many]).alias("_x")), "rank-rows")
        long = rows.select("_row", F.explode("_x").alias("e")).select("_row", "e._i", "e._v")
        total = sum(size[number[c]][1] for c in many)
        own = ranks.filter(F.col("_i").isin([number[c] for c in many]))
        hot = F.broadcast(own.filter(F.col("_c") * HOT_PARTS > total).select("_i", "_v", F.col("_rank").alias("_hot")))
        flagged = long.join(hot, ["_i", "_v"], "left")
        found = flagged.filter(F.col("_hot").isNotNull()).select("_row", "_i", F.col("_hot").alias("_rank")).unionByName(
            flagged.filter(F.col("_hot").isNull()).join(own, ["_i", "_v"]).select("_row", "_i", "_rank"))
        wide = found.groupBy("_row").agg(F.count(F.lit(1)).alias("_n"), *[
            F.max(F.when(F.col("_i") == number[c], F.col("_rank"))).alias(f"_r{number[c]}") for c in many])
        wide = wide.filter(F.col("_n") == len(many))
        joined = rows.select("_row", "_kept").join(wide, "_row")
        out = joined.select(*[F.col("_kept").getField(f"k{k}").alias(c) for k, c in enumerate(rest)],
                            *[F.col(f"_r{number[c]}").alias(c + suffix) for c in many])
    for c in few:
        r = F.broadcast(ranks.filter(F.col("_i") == number[c]).select(F.col("_v").alias("_key"), F.col("_rank").alias("_own")))
        others = [x for x in out.columns if suffix or x != c]
        out = out.join(r, field(c).cast("double") == F.col("_key"), "inner").select(
            *[field(x) for x in others], F.col("_own").alias(c + suffix))
    return out


def _pairs(cols):
    return [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _lit(c: str) -> str:
    return "'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'"


# The wide per-pair projections are written as SQL expression text: one JVM
# call per expression instead of one Py4J call per Column operation.
def _long_form(row: DataFrame, cols: Sequence[str], r_sql: dict) -> DataFrame:
    """One row with an expression per pair -> (feature_x, feature_y, correlation)."""
    row = row.selectExpr(*[f"{e} AS r{i}_{j}" for (i, j), e in r_sql.items()])
    items = []
    for i, j in _pairs(cols):
        items.append(f"named_struct('feature_x', {_lit(cols[i])}, 'feature_y', {_lit(cols[j])}, "
                     f"'correlation', r{i}_{j})")
        if i != j:
            items.append(f"named_struct('feature_x', {_lit(cols[j])}, 'feature_y', {_lit(cols[i])}, "
                         f"'correlation', r{i}_{j})")
    return row.selectExpr(f"explode(array({', '.join(items)})) AS e").select("e.*")


def _clamp(r: str) -> str:
    return f"least(1.0D, greatest(-1.0D, {r}))"


def _pearson_pairwise(base: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise deletion of NULLs: covariance and deviations by pair.  In long form, since one
    aggregate over all pairs is a method too large to be compiled."""
    x = [f"CAST({_q(c)} AS DOUBLE)" for c in cols]
    pairs = list(_pairs(cols))
    items = ", ".join(f"named_struct('p', {p}, 'x', {x[i]}, 'y', {x[j]})" for p, (i, j) in enumerate(pairs))
    sums = (base.selectExpr(f"explode(array({items})) AS e").select("e.*").filter("x IS NOT NULL AND y IS NOT NULL")
            .groupBy("p").agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")))
    names = [(p, cols[a], cols[b]) for p, (i, j) in enumerate(pairs) for a, b in dict.fromkeys([(i, j), (j, i)])]
    # both sides hold one row for each pair of columns
    spec = F.broadcast(base.sparkSession.createDataFrame(names, "p int, feature_x string, feature_y string"))
    r = F.expr(f"CASE WHEN sx > 0 AND sy > 0 THEN {_clamp('c / (sx * sy)')} END")
    return spec.join(sums, "p", "left").select("feature_x", "feature_y", r.alias("correlation"))


def _pearson_centred(base: DataFrame, cols: Sequence[str], means: list[float]) -> DataFrame:
    """No NULLs: one pass of plain sums over values centred by their mean
    (no cancellation, few aggregation buffers, so the pass is codegen'd)."""
    u = [f"(CAST({_q(c)} AS DOUBLE) - CAST({m!r} AS DOUBLE))" for c, m in zip(cols, means)]
    aggs = ["count(1) AS n"] + [f"sum({u[i]}) AS s{i}" for i in range(len(cols))]
    aggs += [f"sum({u[i]} * {u[j]}) AS p{i}_{j}" for i, j in _pairs(cols)]
    row = base.agg(*[F.expr(a) for a in aggs])
    row = row.selectExpr(*[f"CASE WHEN n > 0 THEN p{i}_{j} / n - (s{i} / n) * (s{j} / n) END AS c{i}_{j}"
                           for i, j in _pairs(cols)])
    rs = {(i, j): f"CASE WHEN c{i}_{i} > 0 AND c{j}_{j} > 0 THEN "
                  f"{_clamp(f'c{i}_{j} / sqrt(c{i}_{i} * c{j}_{j})')} END" for i, j in _pairs(cols)}
    return _long_form(row, cols, rs)


# ---------------------------------------------------------------- many columns
WIDE = 40
BLOCK = 128                # columns of a block
TASK_BYTES = 64 << 20      # partial sums that a task holds
FAN_IN = 32
CENTRE_ROWS = 999


def _gram(x: np.ndarray, y: np.ndarray, here: np.ndarray, there: np.ndarray, complete: bool) -> np.ndarray:
    """Sums of a block of columns against another over some rows (missing values as 0), all in
    one vector.  Complete: rows, sums and squares of both sides, products.  Else all of these
    for each pair of columns, over the rows that have both."""
    if complete:
        one = np.array([float(len(x))])
        return np.concatenate([one, x.sum(0), y.sum(0), (x * x).sum(0), (y * y).sum(0), (x.T @ y).ravel()])
    return np.concatenate([m.ravel() for m in (here.T @ there, x.T @ there, here.T @ y, (x * x).T @ there, here.T @ (y * y), x.T @ y)])


def _correlations(sums: np.ndarray, nx: int, ny: int, complete: bool) -> np.ndarray:
    """(nx, ny) correlations from the sums of ``_gram``; nan where a side does not vary."""
    if complete:
        n, rest = sums[0], sums[1:]
        sx, sy, qx, qy = (v for v in np.split(rest[:2 * (nx + ny)], np.cumsum([nx, ny, nx])))
        p = rest[2 * (nx + ny):].reshape(nx, ny)
        sx, qx, sy, qy = sx[:, None], qx[:, None], sy[None, :], qy[None, :]
    else:
        n, sx, sy, qx, qy, p = sums.reshape(6, nx, ny)
    with np.errstate(all="ignore"):
        vx, vy = qx / n - (sx / n) ** 2, qy / n - (sy / n) ** 2
        r = (p / n - sx * sy / n ** 2) / np.sqrt(vx * vy)
        flat = (vx <= 1e-14 * qx / n) | (vy <= 1e-14 * qy / n)
    return np.where(flat, np.nan, np.clip(r, -1.0, 1.0))


def _pearson_wide(base: DataFrame, cols: Sequence[str], block: int = BLOCK, fan_in: int = FAN_IN,
                  task_bytes: int = TASK_BYTES) -> DataFrame:
    """Block-wise Gram matrices, pairwise deletion of NULLs.  One pass over the rows for every
    ``task_bytes`` of partial sums (about 4,000 columns without NULLs)."""
    cols = list(cols)
    counts = base.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(_q(c))).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    if not counts["n"]:
        names = F.array(*[F.lit(c) for c in cols])
        return base.sparkSession.range(1).select(F.explode(names).alias("feature_x")).select(
            "feature_x", F.explode(names).alias("feature_y"), F.lit(None).cast("double").alias("correlation"))
    complete = all(counts[f"c{i}"] == counts["n"] for i in range(len(cols)))
    rows = base.select(F.array(*[F.col(_q(c)).cast("double") for c in cols]).alias("x"))
    # any value near the middle serves as origin; a constant column must become 0 exactly
    some = np.array([r["x"] for r in rows.limit(CENTRE_ROWS).collect()], dtype=np.float64).reshape(-1, len(cols))
    centre = np.array([np.median(v) if len(v) else 0.0 for v in (c[np.isfinite(c)] for c in some.T)])
    starts = list(range(0, len(cols), block))
    pairs = [(i, j) for i in range(len(starts)) for j in range(i, len(starts))]
    each = max(1, task_bytes // (8 * block * block * (1 if complete else 6)))
    parts = None
    for at in range(0, len(pairs), each):
        own = _partial_sums(rows, centre, pairs[at:at + each], starts, block, complete)
        parts = own if parts is None else parts.unionByName(own)
    sums = cut_lineage(parts, "correlation-parts")
    tasks = (sums.agg(F.max("part")).first()[0] or 0) + 1
    while tasks > 1:
        def added(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_py()) for v in table.column("sums"))
            first = table.slice(0, 1)
            return pa.table({"i": first["i"], "j": first["j"], "part": first["part"], "sums": pa.array([total.tobytes()], pa.binary())})
        grouped = sums.withColumn("part", F.expr(f"part div {fan_in}")).groupBy("i", "j", "part")
        sums = cut_lineage(grouped.applyInArrow(added, "i int, j int, part bigint, sums binary"), "correlation-sums")
        tasks = -(-tasks // fan_in)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, v in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                left, right = cols[starts[i]:starts[i] + block], cols[starts[j]:starts[j] + block]
                r = _correlations(np.frombuffer(v), len(left), len(right), complete)
                values = pa.array(r.ravel(), pa.float64(), mask=np.isnan(r.ravel()))
                a, b = np.repeat(left, len(right)).tolist(), left and list(right) * len(left)
                yield pa.record_batch([pa.array(a), pa.array(b), values], names=["feature_x", "feature_y", "correlation"])
                if i != j:
                    yield pa.record_batch([pa.array(b), pa.array(a), values], names=["feature_x", "feature_y", "correlation"])

    return sums.mapInArrow(finished, "feature_x string, feature_y string, correlation double")


def _partial_sums(rows: DataFrame, centre: np.ndarray, pairs: list[tuple[int, int]], starts: list[int], block: int,
                  complete: bool) -> DataFrame:
    """(i, j, part, sums): one row for each task and pair of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0.0] * len(pairs)
        seen = False
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                column = batch.column(0).slice(at, 4096)
                flat = column.flatten()
                x = flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) - centre
                here = None if complete else flat.is_valid().to_numpy(zero_copy_only=False).reshape(x.shape).astype(np.float64)
                if here is not None:
                    x = np.where(here > 0, x, 0.0)
                side = lambda m, k: None if m is None else m[:, starts[k]:starts[k] + block]
                for k, (i, j) in enumerate(pairs):
                    sums[k] = sums[k] + _gram(side(x, i), side(x, j), side(here, i), side(here, j), complete)
                seen = True
        if seen:
            n = TaskContext.get().partitionId()
            yield pa.record_batch([pa.array([i for i, _ in pairs], pa.int32()), pa.array([j for _, j in pairs], pa.int32()),
                                   pa.array([n] * len(pairs), pa.int64()), pa.array([v.tobytes() for v in sums], pa.binary())],
                                  names=["i", "j", "part", "sums"])

    return rows.mapInArrow(run, "i int, j int, part bigint, sums binary")


def correlation_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson", wide: bool | None = None) -> DataFrame:
    """Long form (feature_x, feature_y, correlation) of every ordered pair, diagonal included.
    ``wide`` forces or forbids the way of many columns (Pearson)."""
    cols = list(cols)
    if method == "spearman":
        complete = df.select(*[field(c) for c in cols])
        for c in cols:
            complete = complete.filter(field(c).isNotNull() & ~F.isnan(field(c).cast("double")))
        n = complete.count()  # a pruned scan of the source, no rank joins
        base = average_ranks(complete, cols)
        if n > 0:
            # average ranks of n rows always have the mean (n + 1) / 2, so the
            # rank-joined table is read once, by the centred pass
            return _pearson_centred(base, cols, [(n + 1) / 2.0] * len(cols))
        return _pearson_pairwise(base, cols)
    if method == "pearson":
        base = df.select(*[F.col(_q(c)) for c in cols])
    else:
        raise ValueError(f"unknown method {method!r}")
    if wide or (wide is None and len(cols) > WIDE):
        return _pearson_wide(base, cols)
    first = base.agg(F.count(F.lit(1)).alias("_n"),
                     *[F.count(F.col(_q(c))).alias(f"n{i}") for i, c in enumerate(cols)],
                     *[F.avg(F.col(_q(c)).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    complete = all(first[f"n{i}"] == first["_n"] for i in range(len(cols)))
    if complete and first["_n"] > 0:
        return _pearson_centred(base, cols, [float(first[f"m{i}"]) for i in range(len(cols))])
    return _pearson_pairwise(base, cols)


def target_correlation(df: DataFrame, target: str, features: Sequence[str],
                       method: str = "pearson") -> DataFrame:
    """(feature, correlation, abs_correlation) of each feature with ``target``."""
    m = correlation_matrix(df, [target] + [f for f in features if f != target], method)
    return (m.filter((F.col("feature_x") == target) & (F.col("feature_y") != target))
            .select(F.col("feature_y").alias("feature"), "correlation",
                    F.abs("correlation").alias("abs_correlation")))


def all_target_correlations(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """(target, feature, correlation, abs_correlation) for each column as target
    against all others: one matrix instead of one job per target."""
    m = correlation_matrix(df, cols, method)
    return (m.filter(F.col("feature_x") != F.col("feature_y"))
            .select(F.col("feature_x").alias("target"), F.col("feature_y").alias("feature"),
                    "correlation", F.abs("correlation").alias("abs_correlation")))


def top_features(df: DataFrame, target: str, features: Sequence[str], k: int = 3,
                 method: str = "pearson") -> DataFrame:
    """The ``k`` features most correlated (in absolute value) with ``target``."""
    t = target_correlation(df, target, features, method)
    return t.orderBy(F.col("abs_correlation").desc_nulls_last(), F.col("feature")).limit(k)
