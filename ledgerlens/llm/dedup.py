"""Exact dedup: two-pass Bloom filtering, then grouping of the suspects only.

Pass one hashes every normalised text (SHA-256) into a narrow table and counts, for
two hash functions, how many rows hit each slot of a bit array of fixed size; the
slots hit twice or more become a bitmap.  Pass two probes the bitmap: a row whose two
slots are both marked may be repeated, every other row is certainly single and passes
straight through.  Only suspects are shuffled and grouped by their full hash, which
removes the false positives.

The bit array has a fixed size (``filter_bits``, 16 MB by default), so it can be
broadcast at any input size.  Beyond about ``filter_bits / 10`` rows more and more
rows become suspects; the result stays exact, and the shuffle grows towards one narrow
row per document.

Only DataFrame functions run here: no Python on the executors.

Defined results: a null text counts as empty.  Rows that repeat an id *and* its text
are rows of their own; exactly one row of a group of equal texts is kept, one with the
smallest id.  Null ids lose against any other id; a group of null ids keeps one row.
An empty table gives an empty result.  Extra columns of any name are carried by
``exact_dedup`` and ignored by ``dedup_decisions``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import (bitmap_of_slots, collapse_space, field, join_by_key, unpack, whole_row,
                     with_slot_flag)

FILTER_BITS = 1 << 27


def text_hash(text: Column) -> Column:
    return F.sha2(collapse_space(text), 256)


def _slots(h: Column, bits: int) -> tuple[Column, Column]:
    half = bits // 2
    return (F.pmod(F.xxhash64(h, F.lit(1)), F.lit(half)) + 1,
            F.pmod(F.xxhash64(h, F.lit(2)), F.lit(half)) + 1 + half)


def repeated_slots(hashed: DataFrame, bits: int) -> DataFrame:
    """Pass one: bitmap of the slots that at least two rows hit (rows of one task are
    combined before the shuffle, so a text with any number of copies costs one row)."""
    one, two = _slots(F.col("h"), bits)
    counts = hashed.select(F.explode(F.array(one, two)).alias("slot")).groupBy("slot").count()
    return bitmap_of_slots(counts.filter(F.col("count") > 1).select("slot"))


def with_suspect_flag(rows: DataFrame, bitmap: DataFrame, bits: int) -> DataFrame:
    """Pass two: ``suspect`` is false only for rows whose text is certainly single."""
    one, two = _slots(F.col("h"), bits)
    out = with_slot_flag(rows, bitmap, one, "_s1")
    out = with_slot_flag(out, bitmap, two, "_s2")
    return out.withColumn("suspect", F.col("_s1") & F.col("_s2")).drop("_s1", "_s2")


def dedup_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = cut_lineage(docs.select(field(id_col).alias("doc_id"), text_hash(field(text_col)).alias("h")),
                         "dedup-hashes")
    bitmap = cut_lineage(repeated_slots(hashed, filter_bits), "dedup-bitmap")
    flagged = with_suspect_flag(hashed, bitmap, filter_bits)
    single = flagged.filter(~F.col("suspect")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), F.col("h").alias("text_sha256"))
    # rows of one id and text are counted before anything else moves
    members = cut_lineage(flagged.filter("suspect").groupBy("h", "doc_id").agg(F.count(F.lit(1)).alias("copies")),
                          "dedup-suspects")
    total = members.agg(F.coalesce(F.count(F.lit(1)), F.lit(0))).first()[0]
    groups = members.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"),
                                      F.count(F.lit(1)).alias("_n"))
    grouped = join_by_key(members, groups, "h", "_n", total)
    repeated = (grouped.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
                .select("doc_id", "keep_id", "group_size",
                        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
                        F.col("h").alias("text_sha256")))
    return single.unionByName(repeated)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  Rows with a single text
    never move; suspects meet their group's smallest id on (hash, id), a key that a
    large group of copies does not make hot."""
    hashed = cut_lineage(docs.select(field(id_col).alias("id"), text_hash(field(text_col)).alias("h")),
                         "dedup-hashes")
    bitmap = cut_lineage(repeated_slots(hashed, filter_bits), "dedup-bitmap")
    keepers = (with_suspect_flag(hashed, bitmap, filter_bits).filter("suspect")
               .groupBy("h").agg(F.min("id").alias("id")))
    rows = with_suspect_flag(docs.select(whole_row(docs).alias("row"), field(id_col).alias("id"),
                                         text_hash(field(text_col)).alias("h")), bitmap, filter_bits)
    single = rows.filter(~F.col("suspect")).select("row")
    same = [rows["h"] == keepers["h"], rows["id"].eqNullSafe(keepers["id"])]
    kept = (rows.filter("suspect").join(keepers, same, "left_semi")
            .dropDuplicates(["h"]).select("row"))  # one of the rows that repeat the id and its text
    return unpack(single.unionByName(kept), docs.columns)


ORACLE_SQL = """
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS h
           FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.h AS text_sha256
FROM n JOIN g ON n.h = g.h
"""
