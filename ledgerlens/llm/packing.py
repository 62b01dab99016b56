"""Mixture-controlled packing by deficit round-robin over source queues.

Every document becomes token ids and one closing id; ids are cut into sequences of
``window`` tokens.  Each source is a queue of its documents.  In a round each source's
deficit grows by its quantum, ``window`` tokens times its target share, and the source
serves what its deficit covers: whole tokens where the quantum is ``grant`` or more, else
it waits until the deficit holds a grant.  What a queue has not served carries over to the
next round.  The served tokens in order of (round, source, place in the queue) are the
stream, and each ``window`` tokens of it are one sequence, so every sequence holds the
target shares to within about a grant for each source.  Without weights the target shares are the
sources' own shares of all tokens, so all queues end in the same round; with weights, a
source that has run dry leaves its share to the others.

The rounds need no simulation.  After r rounds a source has served the floor of r quanta,
so the round of each token follows from its place in its queue alone, whichever partition
it lies in, and no deficit is lost between partitions.  A token's place is a prefix sum:
items (documents, long ones in parts) get hash-random ranges, one row for each (source,
range) cell gives the offsets.  The stream's places are prefix sums over ranges of rounds
in the same way.  A source of any size is spread over all ranges; only narrow rows
(place, length) are sorted, and the ids move once, in the join with their pieces.

Tokens: a text goes to the library in sections of about a megabyte that end at safe
boundaries of byte-level pre-tokens (before an ASCII white space after a character that is
none).  Sections without very long pre-tokens go to a faster library that holds the same
vocabulary; others, and vocabularies that it cannot hold, to the tokenizer itself.  Tests
compare both on every letter.  Memory is about the ids of the longest text; a stretch without a safe boundary is one library call.  Ids are kept as 16-bit
numbers where the vocabulary allows, and are widened in the pieces.

The last window is cut into sequences of descending powers of two instead of padding it,
so no sequence needs padding.

Defined results: a null or empty text is the closing id alone; a null source is a queue of
its own; special strings inside texts are as the library's default has them; repeated rows
and ids are packed once for each row; null ids are carried.  An empty table gives an empty
result.  The order in a queue is a hash of the row's place in the input, so runs over the
same files agree.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running_sums
from ..session import cut_lineage
from .common import field, join_by_key, map_arrow
from .words import BATCH_BYTES, SPACES, each

WINDOW = 2048
GRANT = 128
CLOSING_ID = 1
ITEM_TOKENS = 1 << 16
ROWS_PER_RANGE = 4096
ROUNDS_PER_RANGE = 1024

# --- token ids ---------------------------------------------------------------------

_ASCII_SPACE = np.zeros(256, dtype=bool)
_ASCII_SPACE[list(SPACES)] = True
_CONTROL_SPACE = _ASCII_SPACE.copy()
_CONTROL_SPACE[0x1C:0x20] = True


def _wide_space(p3: np.ndarray, p2: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """Do these last three bytes end in a white space beyond ASCII?  Fixed values: U+0085,
    U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000 in UTF-8."""
    two = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
    general = (p3 == 0xE2) & (p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF))
    other = (((p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)) | ((p3 == 0xE2) & (p2 == 0x81) & (p1 == 0x9F))
             | ((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)))
    return two | general | other


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Places before an ASCII white space that follows a character that is no white space."""
    at = np.flatnonzero(_ASCII_SPACE[data[1:]] & ~_CONTROL_SPACE[data[:-1]]) + 1
    beyond = np.flatnonzero(data[at - 1] >= 0x80)
    if len(beyond):
        k = at[beyond]
        wide = _wide_space(data[np.maximum(k - 3, 0)], data[np.maximum(k - 2, 0)], data[k - 1])
        at = np.delete(at, beyond[wide])
    return at


def sections(text: bytes, limit: int) -> Iterator[bytes]:
    """The text in sections of at most ``limit`` bytes that end at safe places; longer only
    where there is none."""
    at, size = 0, limit
    while len(text) - at > size:
        cuts = safe_cuts(np.frombuffer(text, np.uint8, size, at))
        if len(cuts):
            yield text[at:at + int(cuts[-1])]
            at, size = at + int(cuts[-1]), limit
        else:
            size *= 2
    yield text[at:]


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones of
    Latin-1 stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# Fixed value: the pattern of byte-level pre-tokens.
PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_RUN = 256     # the faster library takes the square of a pre-token's length


def fast_encoding(path: str, tokenizer):
    """The same vocabulary in a faster library, or None where it would not be the same: the
    ids must follow the order of the merges, the pre-tokens the usual pattern."""
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    added = tokenizer.get_added_tokens_decoder()
    usual = (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
             and pre.get("use_regex", True) and spec.get("normalizer") is None and not model.get("ignore_merges")
             and not model.get("dropout") and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix"))
    made = [model["vocab"].get(a + b, -1) for a, b in merges] if usual else []
    if not usual or made != sorted(made) or any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
        return None
    byte_of = _byte_of()
    special = {t.content: i for i, t in added.items()}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    return tiktoken.Encoding("packing", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)


def _short_runs(data: np.ndarray) -> bool:
    """Is every run of white space or of other bytes at most LONG_RUN long?"""
    if len(data) <= LONG_RUN:
        return True
    turns = np.flatnonzero(np.diff(_ASCII_SPACE[data]))
    return len(turns) > 0 and int(np.diff(turns, prepend=0, append=len(data)).max()) <= LONG_RUN


class Encoder:
    """Token ids of whole texts, as the tokenizer gives them without added tokens."""

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.fast = fast_encoding(path, self.tokenizer)
        self.batch_bytes = batch_bytes

    def _section(self, text: bytes) -> np.ndarray:
        decoded = text.decode("utf-8", "replace")
        if self.fast is not None and _short_runs(np.frombuffer(text, dtype=np.uint8)):
            return self.fast.encode_to_numpy(decoded, allowed_special="all").astype(np.uint32)
        return np.array(self.tokenizer.encode(decoded, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, text: bytes | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        parts = [self._section(part) for part in sections(text, self.batch_bytes)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


_ENCODERS: dict[str, Encoder] = {}    # one for each worker process and tokenizer


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def id_width(encoder: Encoder, closing_id: int) -> str:
    return "<u2" if max(encoder.tokenizer.get_vocab_size(with_added_tokens=True) - 1, closing_id) < 1 << 16 else "<u4"


def token_items(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", closing_id: int = CLOSING_ID, item_tokens: int = ITEM_TOKENS) -> DataFrame:
    """(item, doc_id, source, start, n, doc_tokens, ids): whole documents, or their parts of
    ``item_tokens``; item unique, ids little-endian unsigned numbers of ``id_width``."""
    narrow = docs.select(field(id_col).alias("doc_id"), field(source_col).cast("string").alias("source"),
                         F.coalesce(field(text_col), F.lit("")).cast("binary").alias("text"))
    names = ["item", "doc_id", "source", "start", "n", "doc_tokens", "ids"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        width = id_width(encoder, closing_id)
        item = TaskContext.get().partitionId() << 40
        for part in parts:
            rows: list[tuple] = []
            held = 0

            def batch(part=part) -> pa.RecordBatch:
                at = pa.array([r[0] for r in rows], pa.int64())
                numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3, 4)]
                return pa.record_batch([numbers[0], part.column(0).take(at), part.column(1).take(at), *numbers[1:],
                                        pa.array([r[5] for r in rows], pa.binary())], names=names)

            for k, text in enumerate(each(part.column(2))):
                ids = np.append(encoder.encode(text), np.uint32(closing_id)).astype(width)
                for start in range(0, len(ids), item_tokens):
                    own = ids[start:start + item_tokens]
                    rows.append((k, item, start, len(own), len(ids), own.tobytes()))
                    item += 1
                    held += own.nbytes
                if held >= 4 * BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
            if rows:
                yield batch()

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return map_arrow(narrow, run, f"item bigint, doc_id {kind}, source string, start bigint, n bigint, "
                                  "doc_tokens bigint, ids binary")


# --- rounds --------------------------------------------------------------------------

def _range(key: Column, n_ranges: int) -> Column:
    return F.shiftright(F.xxhash64(key, F.lit(12)).bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(n_ranges).cast("bigint"), 32)


def queue_places(items: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, DataFrame]:
    """(item, queue, n, place) with place = tokens of the queue before the item, and
    (queue, tokens, items) per source.  ``queue`` is the source, never null."""
    queue = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("queue")
    n_ranges = max(1, -(-items.count() // rows_per_range))
    sized = items.select("item", queue, "n").withColumn("range", _range(F.col("item"), n_ranges))
    cells = cut_lineage(sized.groupBy("queue", "range").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("items")),
                        "packing-cells")
    before = Window.partitionBy("queue").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("queue", "range", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
    to_here = Window.partitionBy("queue", "range").orderBy(F.xxhash64("item"), "item").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = sized.withColumn("place", F.sum("n").over(to_here) - F.col("n"))
    placed = local.join(offsets, ["queue", "range"]).select(
        "item", "queue", "n", (F.col("place") + F.col("offset")).alias("place"))
    return placed, cells.groupBy("queue").agg(F.sum("tokens").alias("tokens"), F.sum("items").alias("items"))


def _quanta(queues: DataFrame, total: int, window: int, grant: int, weights: Mapping[str | None, float] | None) -> DataFrame:
    """Adds quantum (tokens a round) and block (tokens served at once)."""
    if weights is None:
        quantum = F.col("tokens") / F.lit(float(total)) * window
    else:
        if not weights or min(weights.values()) <= 0:
            raise ValueError("weights must be positive")
        named = F.create_map(*[F.lit(x) for s, w in weights.items() for x in ("" if s is None else f"={s}", float(w))])
        share = F.coalesce(named[F.col("queue")],
                           F.raise_error(F.concat(F.lit("no weight for source "), F.col("queue"))).cast("double"))
        quantum = share / F.lit(float(sum(weights.values()))) * window
    return queues.withColumn("quantum", quantum.cast("double")).withColumn("block", F.greatest("quantum", F.lit(float(grant))))


def served(placed: DataFrame) -> DataFrame:
    """Cuts items into what one round serves of them: (item, begin in the item, length,
    round, queue, place).  ``placed`` has place, n, tokens, quantum and block."""
    # block k of a queue ends at the floor of (k + 1) blocks, the last at the queue's end
    number = F.floor(F.col("place") / F.col("block"))
    last = F.floor((F.col("place") + F.col("n")) / F.col("block"))
    cut = placed.withColumn("k", F.explode(F.sequence(F.greatest(number - 1, F.lit(0)), last + 1)))
    cut = cut.withColumn("low", F.greatest("place", F.floor(F.col("k") * F.col("block"))))
    cut = cut.withColumn("high", F.least(F.col("place") + F.col("n"), F.floor((F.col("k") + 1) * F.col("block"))))
    block_end = F.least("tokens", F.floor((F.col("k") + 1) * F.col("block")))
    return cut.filter("high > low").select(
        "item", (F.col("low") - F.col("place")).alias("begin"), (F.col("high") - F.col("low")).alias("length"),
        F.ceil(block_end / F.col("quantum")).cast("bigint").alias("round"), "queue", F.col("low").alias("place"))


def stream_places(grants: DataFrame, rounds_per_range: int = ROUNDS_PER_RANGE) -> DataFrame:
    """Adds at: the tokens of the stream before each grant, in order of round, queue, place."""
    grants = grants.withColumn("cell", F.expr(f"round div {rounds_per_range}"))
    cells = cut_lineage(grants.groupBy("cell").agg(F.sum("length").alias("tokens")), "packing-rounds")
    offsets = running_sums(cells, ["cell"], ["tokens"]).select("cell", (F.col("cum_tokens") - F.col("tokens")).alias("offset"))
    to_here = Window.partitionBy("cell").orderBy("round", "queue", "place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = grants.withColumn("at", F.sum("length").over(to_here) - F.col("length"))
    return local.join(offsets, "cell").withColumn("at", F.col("at") + F.col("offset")).drop("cell", "offset")


def tail_cuts(total: int, window: int) -> list[tuple[int, int, int]]:
    """(sequence, begin, end) of the stream's tokens after the last full window: sequences of
    descending powers of two, at most one of each."""
    at, out = total - total % window, []
    size = 1 << max(0, window.bit_length() - 1)
    while size:
        if total - at >= size:
            out.append((total // window + len(out), at, at + size))
            at += size
        else:
            size >>= 1
    return out


def _sequences(stream: DataFrame, total: int, window: int) -> DataFrame:
    """Cuts grants at the sequences' ends: adds sequence_id and offset."""
    full = total // window
    cut = stream.withColumn("w", F.explode(F.sequence(F.expr(f"at div {window}"), F.expr(f"(at + length - 1) div {window}"))))
    plain = f"array(named_struct('s', w, 'lo', w * {window}, 'hi', (w + 1) * {window}))"
    tail = ", ".join(f"named_struct('s', {s}L, 'lo', {a}L, 'hi', {b}L)" for s, a, b in tail_cuts(total, window))
    if tail:
        plain = f"CASE WHEN w < {full} THEN {plain} ELSE array({tail}) END"
    cut = cut.withColumn("s", F.explode(F.expr(plain)))
    cut = cut.withColumn("low", F.greatest("at", "s.lo")).withColumn("high", F.least(F.col("at") + F.col("length"), F.col("s.hi")))
    return cut.filter("high > low").select(
        "item", (F.col("begin") + F.col("low") - F.col("at")).alias("begin"), (F.col("high") - F.col("low")).alias("length"),
        F.col("s.s").alias("sequence_id"), (F.col("low") - F.col("s.lo")).alias("offset"), "round")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         window: int = WINDOW, grant: int = GRANT, weights: Mapping[str | None, float] | None = None,
         closing_id: int = CLOSING_ID, item_tokens: int = ITEM_TOKENS, rows_per_range: int = ROWS_PER_RANGE,
         rounds_per_range: int = ROUNDS_PER_RANGE) -> DataFrame:
    """One row per piece: doc_id, source, start, length, doc_tokens, sequence_id, offset,
    round, ids (little-endian unsigned 32-bit).  ``weights`` (source to weight; null as
    None) must name every source; without it each source weighs its tokens."""
    items = cut_lineage(token_items(docs, tokenizer, id_col, text_col, source_col, closing_id, item_tokens), "packing-items")
    placed, queues = queue_places(items, rows_per_range)
    queues = cut_lineage(queues, "packing-queues")
    total, count = queues.agg(F.sum("tokens"), F.sum("items")).first()
    quanta = _quanta(queues, total or 1, window, grant, weights)
    placed = cut_lineage(placed, "packing-places")
    grants = cut_lineage(served(join_by_key(placed, quanta, "queue", "items", count or 0)), "packing-grants")
    pieces = _sequences(stream_places(grants, rounds_per_range), total or 0, window)
    # an item has at most item_tokens / grant + a few pieces, so the ids move once
    cuts = pieces.groupBy("item").agg(F.collect_list(F.struct("begin", "length", "sequence_id", "offset", "round")).alias("cuts"))
    joined = items.join(cuts, "item").select(
        "doc_id", "source", "start", "doc_tokens", "n", F.col("cuts.begin").alias("begin"), F.col("cuts.length").alias("length"),
        F.col("cuts.sequence_id").alias("sequence_id"), F.col("cuts.offset").alias("offset"), F.col("cuts.round").alias("round"), "ids")
    return _pieces(joined).select("doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "round", "ids")


def _pieces(joined: DataFrame) -> DataFrame:
    """One row per piece of each item, with its ids widened to 32 bits."""
    numbers = ["length", "sequence_id", "offset", "round"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = part.schema.get_field_index
            begin = part.column(at("begin"))
            for low in range(0, part.num_rows, 256):
                rows = range(low, min(part.num_rows, low + 256))
                which, starts, own = [], [], []
                for k in rows:
                    raw, n = part.column(at("ids"))[k].as_buffer(), part.column(at("n"))[k].as_py()
                    ids = np.frombuffer(raw, dtype="<u2" if raw.size == 2 * n else "<u4").astype("<u4").tobytes()
                    first = part.column(at("start"))[k].as_py()
                    lengths = part.column(at("length"))[k].values.to_pylist()
                    for a, m in zip(begin[k].values.to_pylist(), lengths, strict=True):
                        own.append(ids[4 * a:4 * (a + m)])
                        starts.append(first + a)
                    which += [k] * len(lengths)
                taken = pa.array(which, pa.int64())
                flat = [pa.concat_arrays([part.column(at(c))[k].values for k in rows]) for c in numbers]
                yield pa.record_batch(
                    [part.column(at("doc_id")).take(taken), part.column(at("source")).take(taken), pa.array(starts, pa.int64()),
                     part.column(at("doc_tokens")).take(taken), *flat, pa.array(own, pa.binary())],
                    names=["doc_id", "source", "start", "doc_tokens", *numbers, "ids"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    return map_arrow(joined, run, f"doc_id {kind}, source string, start bigint, doc_tokens bigint, length bigint, "
                                  "sequence_id bigint, offset bigint, round bigint, ids binary")
