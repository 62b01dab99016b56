"""Substring dedup by prefix-partitioned groups of hashed word windows.

A window is ``n`` consecutive words of a document.  Words are removed that lie in a window
whose word sequence also starts in a document with a smaller id.

1. Exact copies are set aside first: such a document loses all its words to the smallest
   id of its group, and only that one goes on.
2. Only suffixes that share their first ``n`` words with a suffix of another document can
   end below a deep internal node.  Every window is represented by its anchor, the smallest
   hash of the 7-word runs in it; equal windows have equal anchors, and neighbouring windows
   mostly share theirs.  Anchors found in one document only are counted out.  Those found in
   two or more are marked in a bitmap of fixed size, which may be sent to every task.
3. Suffixes with a marked anchor are split into groups by prefixes of variable length: by
   the first word, where that is too many by the first four, else by all ``n``; no group
   holds more than a thousandth of the suffixes (or GROUP_ROWS).  A prefix of ``n`` words
   that still does is a single node; its suffixes are spread by document, together with the
   node's smallest document id.  One aggregate by node gives all of these counts; what is
   too large at one length (fewer than 1,000 prefixes or nodes) goes into the plan as
   literals, so the suffixes themselves pass no join.
4. A task sorts the suffixes of its groups by the hashes of their ``n``-word paths.  A run of
   equal hashes stands for the internal node of depth ``n`` that a suffix tree has there; its
   suffixes in documents after the first are repeats.  No tree is built: there are no
   common-prefix lengths and no deeper nodes, which the result does not need.
5. Each document joins its repeated windows into maximal passages and drops their words.
   In a large corpus most documents share some window, so all texts meet their repeats by
   one join on the id.

Paths are compared by 64-bit hashes of the word runs.

Defined results: null or empty texts, and texts of fewer than ``n`` words, lose nothing.
Rows with a null id lose nothing and take nothing from others.  Rows that repeat an id do not
count as smaller than each other.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import bitmap_of, bitmap_of_slots, field, map_arrow, with_member_flag
from .dedup import dedup_decisions, text_hash
from .words import each, hash_runs, hash_runs_at, hashed_texts, runs_within, word_hashes

WINDOW = 13
ANCHOR_WORDS = 7
ANCHOR_BITS = 1 << 27     # 16 MB at any input size
GROUP_ROWS = 1000
PREFIXES = (1 << 12, 1 << 16, 1 << 20)    # groups of prefixes of one word, four and n


def _short(x: np.ndarray) -> np.ndarray:
    """The low 32 bits."""
    return x.astype(np.uint64).astype(np.uint32).view(np.int32)


def window_anchors(h: np.ndarray, first: np.ndarray, n: int = WINDOW, k: int = ANCHOR_WORDS
                   ) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, their anchors) for all texts at once."""
    at = runs_within(first, n)
    if not len(at):
        return at, np.zeros(0, dtype=np.uint64)
    grams = hash_runs(h, k)
    low = grams[: len(h) - n + 1].copy()
    for i in range(1, n - k + 1):
        np.minimum(low, grams[i:len(h) - n + 1 + i], out=low)
    return at, low[at]


def _anchor_lists(docs: DataFrame, n: int) -> DataFrame:
    """(anchors): the distinct anchors of each text."""
    schema = pa.schema([("anchors", pa.list_(pa.int64()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, h, first in hashed_texts(each(part.column(0))):
                at, anchor = window_anchors(h, first, n)
                cuts = np.searchsorted(at, first)
                lists = [np.unique(anchor[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
                ends = np.cumsum([0, *map(len, lists)])
                values = np.concatenate(lists).view(np.int64) if lists else np.zeros(0, dtype=np.int64)
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
                                      schema=schema)

    return map_arrow(docs.select(field("text").cast("binary").alias("text")), run, "anchors array<bigint>")


def _shared_anchor_bits(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """One bit for each anchor slot that two or more documents use; ``bits / 8`` bytes."""
    shared = (_anchor_lists(docs, n).select(F.explode("anchors").alias("anchor"))
              .groupBy("anchor").count().filter("count > 1"))
    slots = shared.select((F.col("anchor").bitwiseAND(F.lit(bits - 1).cast("bigint")) + 1).alias("slot"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in cut_lineage(bitmap_of_slots(slots), "substring-anchors").toLocalIterator():
        piece = np.frombuffer(r["bits"], dtype=np.uint8)
        begin = (r["bucket"] - 1) * len(piece)
        out[begin:begin + len(piece)] = piece[:len(out) - begin]
    return out


def _suspect_suffixes(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """(doc_id, start, w1, w4, path): suffixes whose window has a marked anchor; w1 and w4
    stand for the first word and the first four, path for all ``n``."""
    spark = docs.sparkSession
    marked = spark.sparkContext.broadcast(_shared_anchor_bits(docs, n, bits))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("w1", pa.int32()), ("w4", pa.int32()),
                        ("path", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = marked.value
        for part in parts:
            ids = part.column(0).to_numpy(zero_copy_only=False)
            for begin, h, first in hashed_texts(each(part.column(1))):
                at, anchor = window_anchors(h, first, n)
                slot = anchor & np.uint64(bits - 1)
                at = at[(bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0]
                if not len(at):
                    continue
                text = np.searchsorted(first, at, side="right") - 1
                yield pa.record_batch([
                    ids[begin + text].astype(np.int64), (at - first[text]).astype(np.int32), _short(h[at]),
                    _short(hash_runs_at(h, at, min(4, n))), hash_runs_at(h, at, n).view(np.int64)], schema=schema)

    narrow = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", field("text").cast("binary").alias("text"))
    return cut_lineage(map_arrow(narrow, run, "doc_id bigint, start int, w1 int, w4 int, path bigint"),
                       "substring-suffixes")


def _subtrees(groups: DataFrame) -> DataFrame:
    """Repeats of the suffixes that share a prefix group: ``groups`` has (prefix, path,
    doc_id, start, least); least is the node's smallest id where it is known beforehand.
    Runs are followed across batches with one node in memory."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("path", pa.int32())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, smallest = None, 0
        for part in parts:
            if not part.num_rows:
                continue
            prefix, path, doc, start = (part.column(i).to_numpy() for i in range(4))
            new = np.ones(len(path), dtype=bool)
            new[1:] = (path[1:] != path[:-1]) | (prefix[1:] != prefix[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(path)), 0))
            least = doc[head].copy()
            if node == (prefix[0], path[0]):
                least[head == 0] = smallest
            node, smallest = (prefix[-1], path[-1]), least[-1]
            known = part.column(4).is_valid().to_numpy(zero_copy_only=False)
            later = doc > np.where(known, part.column(4).fill_null(0).to_numpy(), least)
            yield pa.record_batch([doc[later], start[later], _short(path[later])], schema=schema)

    ordered = groups.repartition("prefix").sortWithinPartitions("prefix", "path", "doc_id")
    return map_arrow(ordered, run, "doc_id bigint, start int, path int")


def _repeats(suffixes: DataFrame, group_rows: int) -> DataFrame:
    """(doc_id, start, path) of the suffixes below a deep node whose first document is another;
    path shortened to 32 bits."""
    total = suffixes.count()
    limit = max(group_rows, total // 1000)      # fewer than 1,000 groups of one length hold more
    # groups of prefixes: few enough that counting them moves next to nothing
    rows = suffixes.select(
        "doc_id", "start", "path", F.col("w1").bitwiseAND(F.lit(PREFIXES[0] - 1)).alias("p1"),
        (F.col("w4").bitwiseAND(F.lit(PREFIXES[1] - 1)) + PREFIXES[0]).alias("p4"),
        (F.col("path").bitwiseAND(F.lit(PREFIXES[2] - 1)).cast("int") + PREFIXES[0] + PREFIXES[1]).alias("pn"))

    # all counts come from one aggregate, combined on the map side, with a row for each node;
    # what holds more than limit suffixes numbers fewer than 1,000 at each length
    counts = cut_lineage(rows.groupBy("p1", "p4", "pn", "path").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "substring-counts")
    large: dict[str, list[int]] = {}
    for key in ("p1", "p4", "pn"):
        sums = counts.groupBy(key).agg(F.sum("n").alias("n")).filter(F.col("n") > limit)
        large[key] = [r[key] for r in sums.collect()]
        counts = counts.filter(F.col(key).isin(large[key]))
    nodes = {r["path"]: r["least"] for r in counts.groupBy("path").agg(
        F.sum("n").alias("n"), F.min("least").alias("least")).filter(F.col("n") > limit).collect()}
    # nodes that alone hold too many are spread by document, with their smallest id
    hot = F.col("path").isin(list(nodes))
    least = F.lit(None).cast("bigint")
    if nodes:
        known = F.create_map(*[F.lit(x).cast("bigint") for pair in nodes.items() for x in pair])
        least = F.when(hot, known[F.col("path")])
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(PREFIXES[1])).cast("int") + sum(PREFIXES)
    prefix = (F.when(hot, salt).when(~F.col("p1").isin(large["p1"]), F.col("p1"))
              .when(~F.col("p4").isin(large["p4"]), F.col("p4")).otherwise(F.col("pn")))
    return _subtrees(rows.select(prefix.alias("prefix"), "path", "doc_id", "start", least.alias("least")))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                  ("passages", pa.list_(pa.list_(pa.int32()))), ("kept_text", pa.binary())])


def drop_windows(text: bytes, starts: np.ndarray, paths: np.ndarray, all_of_it: bool, n: int
                 ) -> tuple[list[bytes], int, list[list[int]]]:
    """(kept words, number of all words, maximal passages removed as [start, end))."""
    words = text.split()        # bytes: exactly the six ASCII spaces
    total = len(words)
    if all_of_it and total >= n:
        return [], total, [[0, total]]
    if len(starts) and total >= n:
        fits = starts <= total - n
        starts, paths = starts[fits], paths[fits]
        h = word_hashes(text)
        starts = np.sort(starts[_short(hash_runs_at(h, starts, n)) == paths])   # of this row, if ids repeat
    if not len(starts) or total < n:
        return words, total, []
    cut = np.flatnonzero(np.diff(starts) > n)
    begin, end = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + n
    kept: list[bytes] = []
    at = 0
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        kept += words[at:a]
        at = b
    kept += words[at:]
    return kept, total, np.column_stack([begin, end]).tolist()


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW,
                    anchor_bits: int = ANCHOR_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, passages (removed word ranges,
    [start, end)), kept_text (the kept words joined by one space)."""
    named = docs.select(field(id_col).cast("bigint").alias("doc_id"), field(text_col).alias("text"))
    copies = cut_lineage(dedup_decisions(named).filter(F.col("doc_id") != F.col("keep_id"))
                         .select("doc_id", F.col("text_sha256").alias("h")), "substring-copies")
    rows = named.withColumn("h", text_hash(F.col("text")))
    # rows that may be copies are few; only they move
    flagged = with_member_flag(rows, cut_lineage(bitmap_of(copies, F.col("doc_id")), "substring-copy-bits"),
                               F.col("doc_id"), "copy")
    unique = (flagged.filter(~F.col("copy")).select("doc_id", "text")
              .unionByName(flagged.filter("copy").join(copies, ["doc_id", "h"], "left_anti").select("doc_id", "text")))
    repeats = cut_lineage(
        _repeats(_suspect_suffixes(unique, n, anchor_bits), group_rows).groupBy("doc_id")
        .agg(F.collect_list("start").alias("starts"), F.collect_list("path").alias("paths")), "substring-repeats")

    none = F.array().cast("array<int>")
    copied = copies.groupBy("doc_id").agg(F.collect_set("h").alias("hashes"))    # one hash, unless ids repeat
    found = repeats.join(copied, "doc_id", "full")
    joined = rows.join(found, "doc_id", "left").select(
        "doc_id", F.col("text").cast("binary").alias("text"), F.coalesce("starts", none).alias("starts"),
        F.coalesce("paths", none).alias("paths"),
        F.coalesce(F.array_contains("hashes", F.col("h")), F.lit(False)).alias("copy"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            held = 0
            for i in range(part.num_rows):
                id_, text, starts, paths, copy = (part.column(k)[i] for k in range(5))
                text = text.as_py() or b""
                kept, total, passages = drop_windows(text, starts.values.to_numpy().astype(np.int64),
                                                     paths.values.to_numpy(), copy.as_py(), n)
                out.append((id_.as_py(), total, total - len(kept), passages, b" ".join(kept)))
                held += len(text)
                if held >= 4 << 20 or i == part.num_rows - 1:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)],
                                          schema=_OUT)
                    out, held = [], 0

    return map_arrow(joined, run, "doc_id bigint, n_words bigint, n_removed bigint, passages array<array<int>>, "
                                "kept_text binary").withColumn("kept_text", F.col("kept_text").cast("string"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS s
      FROM d, unnest(range(1, len(words) - 11)) AS t(i)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
r AS (SELECT w.doc_id, list(w.i) AS starts FROM w JOIN m ON w.s = m.s AND w.doc_id > m.least GROUP BY w.doc_id),
c AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 13)))) AS gone FROM r),
k AS (SELECT d.doc_id, words, coalesce(gone, []) AS gone FROM d LEFT JOIN c ON d.doc_id = c.doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, j: NOT list_contains(gone, j)), ' ')) AS kept_sha256
FROM k
"""
