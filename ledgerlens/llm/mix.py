"""Mixing sources to target weights.

Every document gets a hash-random key (md5 of a seed, its id and its size).  Sources
are ordered by code point, null last, and weigh 1, 2, 3, repeating; targets share a
total by weight, no source above ``max_epochs`` times its own size, the excess going
to the others by weight.  A source takes its documents in key order: whole epochs
first, then up to the exact word at which the rest of the budget ends.

The order is never built in one task.  Keys are cut into equal ranges; the sizes of
(source, range) cells give each source's running sums, one row per cell; only the rows
of the one range where a source's budget ends are sorted.  What comes out is one cut
per source (epochs, the key at the cut, the words taken there), so each document's
share is a row-local comparison with its source's cut.  A source that holds a third of
all rows is spread over all ranges.

Defined results: null or empty texts have size 0 and are never taken.  A null source is
a source of its own, ordered last.  Rows that repeat id, source and size tie on the
key; at a cut they share what is left equally, rounded down.  An empty table gives an
empty result.  Reruns and retries give the same rows: no draw depends on the
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running_sums
from ..session import cut_lineage
from .common import WS, field, unpack, whole_row, word_count

SEED = 7
MAX_EPOCHS = 3
ROWS_PER_RANGE = 50_000   # rows of one source sorted at its cut, on average at most


def _key(id_: Column, size: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(f"mix{seed}"), F.coalesce(id_.cast("string"), F.lit("null")),
                             size.cast("string")))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    d = docs.select(field(id_col).alias("doc_id"), field(source_col).cast("string").alias("source"),
                    word_count(field(text_col)).alias("size"))
    return d.withColumn("key", _key(F.col("doc_id"), F.col("size"), seed))


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes``: (source, source_size).  Adds target (double) and budget (whole words).

    With caps c = max_epochs * size, the fixed point of sharing and re-sharing gives
    min(c, weight * level), where level spends the total exactly.  Sorted by c / weight,
    a source is capped if the level that the sources from it on would share exceeds its
    ratio; running sums in that order find the level."""
    s = sizes.select("source", "source_size", F.col("source").isNull().cast("int").alias("_null"),
                     F.coalesce("source", F.lit("")).alias("_name"), F.lit(1).cast("bigint").alias("_one"))
    s = cut_lineage(running_sums(s, ["_null", "_name"], ["_one"]), "mix-sources")
    s = s.select("source", "source_size", "_null", "_name",
                 ((F.col("cum__one") - 1) % 3 + 1).alias("weight"),
                 (F.col("source_size") * max_epochs).alias("cap"))
    s = s.withColumn("_ratio", F.col("cap") / F.col("weight"))
    s = cut_lineage(running_sums(s, ["_ratio", "_null", "_name"], ["cap", "weight"]), "mix-ratios")
    total = s.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    t, w = int(total["t"] or 0), int(total["w"] or 0)
    # words and weight left for this source and all after it, were all before it capped
    s = s.withColumn("_left", F.lit(t).cast("bigint") - F.col("cum_cap") + F.col("cap"))
    s = s.withColumn("_weights", F.lit(w).cast("bigint") - F.col("cum_weight") + F.col("weight"))
    s = s.withColumn("_capped", F.col("cap") * F.col("_weights") < F.col("weight") * F.col("_left"))
    free = s.filter(~F.col("_capped")).agg(F.sum("weight").alias("w")).first()["w"]
    spent = s.filter("_capped").agg(F.sum("cap").alias("c")).first()["c"]
    rest, free = t - int(spent or 0), int(free or 1)
    share = F.col("weight") * F.lit(rest).cast("bigint")
    return s.select(
        "source", "source_size",
        F.when(F.col("_capped"), F.col("cap").cast("double")).otherwise(share / F.lit(free)).alias("target"),
        F.when(F.col("_capped"), F.col("cap")).otherwise(F.expr(f"(weight * {rest}L) div {free}L")).alias("budget"))


def _range(key: Column, n_ranges: int) -> Column:
    head = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    return F.shiftright(head * F.lit(n_ranges).cast("bigint"), 32)


def source_cuts(measured: DataFrame, max_epochs: int = MAX_EPOCHS,
                rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(source, source_size, target, epochs, cut_key, cut_words): each source's cut."""
    n = measured.count()
    n_ranges = max(1, -(-n // rows_per_range))
    cells = cut_lineage(
        measured.groupBy("source", _range(F.col("key"), n_ranges).alias("range"))
        .agg(F.sum("size").alias("words")), "mix-cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), max_epochs)
    targets = targets.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
    targets = cut_lineage(targets.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")),
                          "mix-targets")

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["source"].eqNullSafe(b["source"])

    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    at = sums.join(targets.select("source", "rest"), same(sums, targets)).select(
        sums["source"], "range", "start", "rest").filter(
        (F.col("rest") > F.col("start")))
    last = Window.partitionBy("source").orderBy(F.col("range").desc())
    at = at.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
    inside = measured.withColumn("range", _range(F.col("key"), n_ranges))
    inside = inside.join(at, [inside["range"] == at["range"], same(inside, at)]).select(
        inside["source"], "key", "size", "start", "rest")
    ties = inside.groupBy("source", "key", "size", "start", "rest").agg(F.count(F.lit(1)).alias("copies"))
    to_here = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ties = ties.withColumn("end", F.col("start") + F.sum(F.col("size") * F.col("copies")).over(to_here))
    ties = ties.withColumn("begin", F.col("end") - F.col("size") * F.col("copies"))
    cut = ties.filter((F.col("begin") < F.col("rest")) & (F.col("rest") <= F.col("end"))).select(
        "source", F.col("key").alias("cut_key"), F.expr("(rest - begin) div copies").alias("cut_words"))
    return targets.join(cut, same(targets, cut), "left").select(
        targets["source"], "source_size", "target", "epochs",
        F.coalesce("cut_key", F.lit("")).alias("cut_key"),
        F.coalesce("cut_words", F.lit(0)).alias("cut_words"))


def _extra_words() -> Column:
    """Words taken beyond the whole epochs: all before the cut, some at it, none after."""
    return (F.when(F.col("key") < F.col("cut_key"), F.col("size"))
            .when(F.col("key") == F.col("cut_key"), F.least(F.col("size"), F.col("cut_words")))
            .otherwise(F.lit(0)).cast("bigint"))


def mix_shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               max_epochs: int = MAX_EPOCHS, seed: int = SEED,
               rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    measured = cut_lineage(_measured(docs, id_col, text_col, source_col, seed), "mix-sizes")
    cuts = cut_lineage(source_cuts(measured, max_epochs, rows_per_range), "mix-cuts")
    out = measured.join(cuts, measured["source"].eqNullSafe(cuts["source"]))
    return out.select("doc_id", measured["source"].alias("source"), "size", "source_size", "target",
                      (F.col("epochs") * F.col("size") + _extra_words()).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        length_col: str | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
        rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The mixed table: the columns of ``docs``, a document once for each time it is
    taken.  A document at its source's cut is shortened to the words left there, joined
    by one space (``length_col``, if given, then holds its new length); all other texts
    stay as they are.  Documents that the mix does not take are absent."""
    measured = cut_lineage(_measured(docs, id_col, text_col, source_col, seed), "mix-sizes")
    cuts = cut_lineage(source_cuts(measured, max_epochs, rows_per_range), "mix-cuts")
    rows = docs.select(whole_row(docs).alias("row"), field(source_col).cast("string").alias("_source"),
                       word_count(field(text_col)).alias("size"), field(id_col).alias("_id"))
    rows = rows.withColumn("key", _key(F.col("_id"), F.col("size"), seed))
    rows = rows.join(cuts, rows["_source"].eqNullSafe(cuts["source"])).withColumn("extra", _extra_words())
    # 0 for a whole copy, else the words that a shortened copy keeps
    copies = F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.when(F.col("size") > 0, F.col("epochs")).otherwise(0).cast("int")),
                      F.when(F.col("extra") == 0, F.array().cast("array<bigint>"))
                      .when(F.col("extra") == F.col("size"), F.array(F.lit(0).cast("bigint")))
                      .otherwise(F.array("extra")))
    rows = rows.select("row", F.explode(copies).alias("cut"))
    words = F.filter(F.split(F.col("row").getField(text_col), f"[{WS}]+"), lambda w: w != "")
    text = F.when(F.col("cut") == 0, F.col("row").getField(text_col)).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("cut"), F.lit(1)).cast("int")), " "))
    rows = rows.withColumn("row", F.col("row").withField("`" + text_col + "`", text))
    if length_col:
        kind = docs.schema[length_col].dataType
        new = F.when(F.col("cut") == 0, F.col("row").getField(length_col)).otherwise(
            F.length(F.col("row").getField(text_col)).cast(kind))
        rows = rows.withColumn("row", F.col("row").withField("`" + length_col + "`", new))
    return unpack(rows, docs.columns)


ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (SELECT *, md5('mix7|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(size AS VARCHAR)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
             sum(weight) OVER () AS weights, 3.0 * source_size / weight AS ratio FROM s),
q AS (SELECT *, total - sum(cap) OVER w + cap AS left_, weights - sum(weight) OVER w + weight AS weights_
      FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, cap * weights_ < weight * left_ AS capped FROM q),
f AS (SELECT max(total) - coalesce(sum(cap) FILTER (WHERE capped), 0) AS rest,
             coalesce(sum(weight) FILTER (WHERE NOT capped), 1) AS free FROM c),
t AS (SELECT source, source_size,
             CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / free END AS target,
             CAST(CASE WHEN capped THEN cap ELSE (weight * rest) // free END AS BIGINT) AS budget FROM c, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest,
             sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key RANGE UNBOUNDED PRECEDING) AS to_here,
             count(*) OVER (PARTITION BY k.source, k.key) AS copies
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, (rest - (to_here - copies * size)) // copies)) AS BIGINT) AS taken
FROM p
"""
