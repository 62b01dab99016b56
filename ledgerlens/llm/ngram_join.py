"""N-gram Jaccard join with signature trees.

A document's set holds the hashes of its distinct word shingles (A-Z lower-cased).  Two
documents link when 100 * intersection >= ``percent`` * union.  The operator gives each
document its component under these links, exactly.

Routing.  With at most k differences allowed, two linked sets agree in at least one of
k + 1 parts of the hash range.  Sets are put in size classes; a set's keys are the hashes of
its parts, for its own class and for the next if its partners can be there.  Empty parts
would meet everywhere, so a class has some spare parts and a set leaves its empty parts out;
a set with more empty parts than the class has to spare also takes keys in a second, third ...
partitioning, where all such sets meet.  So linked sets always share a key, and sets that
share only common shingles hardly ever do.

Trees.  The sets of one key are the leaves of a signature tree; nodes hold the OR of their
token bitmaps, their size range, the largest number of tokens hidden by shared bits, and
their range of components.  A dual traversal drops node pairs whose largest possible
overlap is too small.  Bitmaps of long sets are full, so these carry a sketch too: the parity
of the tokens at each bit, with a bit for one to two tokens.  The bits in which two sketches
differ are a lower bound of the tokens that only one set has; leaf pairs are dropped by it
where they are found, before they move.  In the first round each leaf proposes its best surviving partner;
proposals are verified on the full sets, and verified links give components.  The second
round looks only at keys that still hold several components and takes all surviving pairs
between different ones; after these are verified nothing is left to link.  A key with more
than ``block`` sets is cut into blocks; every pair of blocks has its own task in round two.

Equal sets are one set from the start, so exact copies cost nothing.

Hashes of shingles and of whole sets have 64 bits.

Defined results: texts with fewer words than a shingle are one shingle; texts without words
(or null) have an empty set and are linked with nothing.  Rows with a null id are linked with
nothing and have a null component.  Rows that repeat an id are documents of their own that
share it.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, cut_lineage_of
from .common import bitmap_of, field, join_by_key, map_arrow, small_batches, unpack, whole_row, with_member_flag
from .graph import components
from .words import each, hash_runs, hashed_texts, mix

WORDS, PERCENT = 5, 80
BLOCK = 512
MAP_BITS = 2048
FAN = 8
LEVELS = 6
SKETCH_BITS = 1 << 15  # 4 KB of a sketch at most
KEY_BITS = 1 << 27     # 16 MB at any input size
BATCH_ROWS = 500       # texts, token sets and bitmaps in a batch
RATIO = 1.5
_MAP_WORDS = MAP_BITS // 64


# --- sets and keys -----------------------------------------------------------------------

def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text with the word hashes ``h``."""
    if not len(h):
        return h
    return np.unique(hash_runs(h, min(n, len(h))))


@lru_cache(maxsize=None)
def size_classes() -> np.ndarray:
    """Smallest size of each class."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, int(low[-1] * RATIO)))
    return np.array(low, dtype=np.int64)


@lru_cache(maxsize=None)
def class_parts(c: int, percent: int) -> tuple[int, int]:
    """(parts, spare parts) of a class: more parts than differences between linked sets of
    which the larger is in the class, and spare ones so that few sets have more empty parts."""
    low, high = int(size_classes()[c]), int(size_classes()[c + 1]) - 1
    differ = 2 * high * (100 - percent) // (100 + percent)
    if not differ:
        return 1, 0
    spare = 0
    while True:
        m = differ + 1 + spare
        empty = m * (1 - 1 / m) ** low
        if empty < 50:
            enough = 1 - sum(math.exp(-empty) * empty ** i / math.factorial(i) for i in range(min(spare, 60) + 1)) < 1e-3
        else:
            enough = spare > empty + 3.1 * math.sqrt(empty)
        if enough or spare > m // 4 + 2:
            return m, spare
        spare += 1


def set_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys under which the set meets every set it may be linked with."""
    size = len(tokens)
    if not size:
        return np.zeros(0, dtype=np.uint64)
    low = size_classes()
    own = int(np.searchsorted(low, size, side="right")) - 1
    last = int(np.searchsorted(low, 100 * size // percent, side="right")) - 1
    out = []
    for c in range(own, last + 1):
        m, spare = class_parts(c, percent)
        for level in range(LEVELS):
            t = tokens if not level else np.sort(mix(tokens ^ np.uint64(0xA24BAED4963EE407 * level & 0xFFFFFFFFFFFFFFFF)))
            part = ((t >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(part, np.arange(m + 1))
            sums = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(mix(t), out=sums[1:])
            full = np.flatnonzero(np.diff(cut))
            used = full if m - len(full) <= spare or level < LEVELS - 1 else np.arange(m)
            place = mix(np.uint64(c << 40 | level << 36) + used.astype(np.uint64))
            out.append(mix((sums[cut[used + 1]] - sums[cut[used]]) ^ place))
            if m - len(full) <= spare:
                break
    return np.concatenate(out)


def token_bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(MAP_BITS, dtype=np.uint8)
    bits[(tokens & np.uint64(MAP_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def parity_sketch(tokens: np.ndarray) -> np.ndarray | None:
    """Parity of the number of tokens at each bit, for sets that half fill the tree's bitmaps
    or more; one or two tokens a bit, up to ``SKETCH_BITS``."""
    if 2 * len(tokens) <= MAP_BITS:
        return None
    size = min(SKETCH_BITS, max(MAP_BITS, 1 << ((len(tokens) + 1) // 2 - 1).bit_length()))
    counts = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little")


def _set_rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, tag, n_shingles, sid, keys, bits, sketch) for each row; sid identifies equal sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n_shingles", pa.int64()), ("sid", pa.int64()),
                        ("keys", pa.list_(pa.int64())), ("bits", pa.binary()), ("sketch", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, tags = part.column(0), part.column(1)
            valid = ids.is_valid().to_pylist()
            for begin, h, first in hashed_texts(each(part.column(2)), lower=True):
                count = len(first) - 1
                sizes, sids, bits, sketches, keys = [], [], [], [], []
                for i in range(count):
                    tokens = shingle_set(h[first[i]:first[i + 1]], n)
                    linkable = len(tokens) and valid[begin + i]
                    sizes.append(len(tokens))
                    sids.append(mix(mix(tokens).sum(keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0]
                                if linkable else None)
                    keys.append(set_keys(tokens, percent) if linkable else np.zeros(0, dtype=np.uint64))
                    bits.append(token_bitmap(tokens).tobytes() if linkable else None)
                    sketch = parity_sketch(tokens) if linkable else None
                    sketches.append(None if sketch is None else sketch.tobytes())
                ends = np.cumsum([0, *map(len, keys)])
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64)
                yield pa.record_batch([ids.slice(begin, count), tags.slice(begin, count), pa.array(sizes, pa.int64()),
                                       pa.array(sids, pa.int64()),
                                       pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                                       pa.array(bits, pa.binary()), pa.array(sketches, pa.binary())], schema=schema)

    return map_arrow(docs.select("doc_id", "tag", field("text").cast("binary").alias("text")), run,
                     "doc_id bigint, tag bigint, n_shingles bigint, sid bigint, keys array<bigint>, bits binary, sketch binary",
                     release=True)


def wide_bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of at least eight bits a token (a power of two in all), for sets that fill the
    tree's bitmaps; an eighth of the tokens' bytes, or up to a quarter."""
    size = 1 << max(MAP_BITS.bit_length() - 1, (8 * len(tokens) - 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def wide_overlap(x: bytes, y: bytes, m: int, n: int) -> int:
    """Upper bound of the overlap of sets of ``m`` and ``n`` tokens from their wide bitmaps;
    the larger bitmap is folded to the other's size."""
    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    while len(a) > len(b):
        a = a[:len(a) // 2] | a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] | b[len(b) // 2:]
    common = int(np.bitwise_count(a & b).sum())
    hidden = min(m - int(np.bitwise_count(a).sum()), n - int(np.bitwise_count(b).sum()))
    return min(common + hidden, m, n)


def _token_rows(docs: DataFrame, n: int, wide: bool = False) -> DataFrame:
    """(sid, tokens) for each row with a set; with ``wide`` (sid, size, bitmap) instead."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, h, first in hashed_texts(each(part.column(0)), lower=True):
                sets = [t for t in (shingle_set(h[a:b], n) for a, b in zip(first[:-1], first[1:], strict=True)) if len(t)]
                sids = pa.array([mix(mix(t).sum(keepdims=True) + np.uint64(len(t))).view(np.int64)[0] for t in sets], pa.int64())
                if wide:
                    yield pa.record_batch([sids, pa.array([len(t) for t in sets], pa.int64()),
                                           pa.array([wide_bitmap(t).tobytes() for t in sets], pa.binary())],
                                          names=["sid", "size", "bitmap"])
                    continue
                ends = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
                yield pa.record_batch([sids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                                      names=["sid", "tokens"])

    schema = "sid bigint, size bigint, bitmap binary" if wide else "sid bigint, tokens array<bigint>"
    return map_arrow(docs.select(field("text").cast("binary").alias("text")), run, schema, release=True)


# --- signature trees -----------------------------------------------------------------------

class Level:
    """Nodes of one height: OR of the bitmaps, size range, tokens hidden by shared bits at
    most, range of components; leaves also have their sketches."""

    def __init__(self, bits, low, high, hidden, root_low, root_high, sketch=None):
        self.bits, self.low, self.high, self.hidden = bits, low, high, hidden
        self.root_low, self.root_high, self.sketch = root_low, root_high, sketch

    def __len__(self) -> int:
        return len(self.low)

    def above(self) -> Level:
        at = np.arange(0, len(self), FAN)
        return Level(np.bitwise_or.reduceat(self.bits, at, axis=0), np.minimum.reduceat(self.low, at),
                     np.maximum.reduceat(self.high, at), np.maximum.reduceat(self.hidden, at),
                     np.minimum.reduceat(self.root_low, at), np.maximum.reduceat(self.root_high, at))


def build_tree(bits: np.ndarray, size: np.ndarray, root: np.ndarray, sketch: list[np.ndarray] | None = None) -> list[Level]:
    """Levels from the leaves up; leaves are best given in order of size."""
    levels = [Level(bits, size, size, size - np.bitwise_count(bits).sum(axis=1), root, root, sketch)]
    while len(levels[-1]) > FAN:
        levels.append(levels[-1].above())
    return levels


def most_overlap(a: Level, b: Level, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap of any leaf below a[i] with any below b[j]: common tokens
    have common bits, and the rest are at most the tokens hidden by shared bits."""
    common = np.bitwise_count(a.bits[i] & b.bits[j]).sum(axis=1).astype(np.int64)
    return np.minimum(common + np.minimum(a.hidden[i], b.hidden[j]), np.minimum(a.high[i], b.high[j]))


def _folded(sketches: list[np.ndarray], words: int) -> np.ndarray:
    """The sketches of at least ``words`` words, folded to that many; zeros for the others."""
    out = np.zeros((len(sketches), words), dtype=np.uint64)
    for k, x in enumerate(sketches):
        if len(x) >= words:
            out[k] = np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)
    return out


def least_differ(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lower bound of the tokens that only one of the sets a[i] and b[j] has: an odd number of
    them where the sketches differ.  The larger sketch is folded; 0 where one set has none."""
    words = np.minimum(np.array([len(x) for x in a])[i], np.array([len(x) for x in b])[j])
    out = np.zeros(len(i), dtype=np.int64)
    for w in np.unique(words[words > 0]).tolist():
        at = np.flatnonzero(words == w)
        x = _folded(a, w)
        y = x if a is b else _folded(b, w)
        step = max(1, (1 << 19) // w)       # 4 MB of sketches at a time
        for k in range(0, len(at), step):
            p = at[k:k + step]
            out[p] = np.bitwise_count(x[i[p]] ^ y[j[p]]).sum(axis=1)
    return out


def overlap_by_sketch(a: Level, b: Level, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """``most`` of leaf pairs, or the bound of their sketches where that is less."""
    if a.sketch is None or b.sketch is None or not len(i):
        return most
    return np.minimum(most, (a.low[i] + b.low[j] - least_differ(a.sketch, b.sketch, i, j)) // 2)


def dual_traversal(a: list[Level], b: list[Level], percent: int, other_root: bool = False
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, overlap bound) of the leaf pairs that no bound excludes; if ``a is b``, i < j.
    With ``other_root`` only pairs of leaves with different components count."""
    same = a is b
    a, b = list(a), list(b)
    while len(a) < len(b):
        a.append(a[-1].above())
    while len(b) < len(a):
        b.append(b[-1].above())
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a[-1])), np.arange(len(b[-1])), indexing="ij"))
    for height in range(len(a) - 1, -1, -1):
        x, y = a[height], b[height]
        fine = (100 * x.high[i] >= percent * y.low[j]) & (100 * y.high[j] >= percent * x.low[i])
        if same:
            fine &= i <= j if height else i < j
        if other_root:
            fine &= (x.root_low[i] != x.root_high[i]) | (y.root_low[j] != y.root_high[j]) | (x.root_low[i] != y.root_low[j])
        i, j = i[fine], j[fine]
        most = most_overlap(x, y, i, j)
        fine = most * (100 + percent) >= percent * (x.low[i] + y.low[j])
        i, j, most = i[fine], j[fine], most[fine]
        if not height:
            most = overlap_by_sketch(x, y, i, j, most)
            fine = most * (100 + percent) >= percent * (x.low[i] + y.low[j])
            i, j, most = i[fine], j[fine], most[fine]
        else:
            kids = np.arange(FAN)
            i = (i[:, None, None] * FAN + kids[None, :, None]) + np.zeros((1, 1, FAN), dtype=np.int64)
            j = (j[:, None, None] * FAN + kids[None, None, :]) + np.zeros((1, FAN, 1), dtype=np.int64)
            i, j = i.ravel(), j.ravel()
            there = (i < len(a[height - 1])) & (j < len(b[height - 1]))
            i, j = i[there], j[there]
    return i, j, most


def best_partners(tree: list[Level], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf the earlier one with the highest similarity bound, if any is left."""
    i, j, most = dual_traversal(tree, tree, percent)
    size = tree[0].low
    likely = most / (size[i] + size[j] - most)
    order = np.lexsort((i, -likely, j))
    lead = order[np.flatnonzero(np.diff(j[order], prepend=-1))]
    return i[lead], j[lead]


def _blocks(parts: Iterator[pa.RecordBatch], key_columns: int) -> Iterator[pa.RecordBatch]:
    """Rows of one block after another; the input is sorted by its first columns, the block."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        if not part.num_rows:
            continue
        keys = np.column_stack([part.column(k).to_numpy() for k in range(key_columns)])
        cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
        if held and tuple(keys[0]) != last:  # noqa: F821
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held = []
        last = tuple(keys[-1])  # noqa: F841
        bounds = [0, *cuts, part.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            held.append(part.slice(a, b - a))
            if b < part.num_rows:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def _bitmaps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, _MAP_WORDS)


def _sketches(column: pa.Array) -> list[np.ndarray]:
    """Words of each row's sketch, none for a null."""
    return [np.frombuffer(x or b"", dtype=np.uint64) for x in column.to_pylist()]


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pair_batches(found: Iterator[tuple[np.ndarray, np.ndarray]], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    held = 0
    for a, b in found:
        if len(a):
            left.append(np.minimum(a, b))
            right.append(np.maximum(a, b))
            held += len(a)
        if held >= rows:
            yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=_PAIR)
            left, right, held = [], [], 0
    if held:
        yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=_PAIR)


def _proposals(members: DataFrame, percent: int) -> DataFrame:
    """Round one: each leaf's best partner in its block, and the block's first set with the
    first set of its key."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for block in _blocks(parts, 2):
                sid, size, first = (block.column(k).to_numpy() for k in (2, 3, 6))
                if len(sid) > 1:
                    tree = build_tree(_bitmaps(block.column(4)), size, sid, _sketches(block.column(5)))
                    i, j = best_partners(tree, percent)
                    yield sid[i], sid[j]
                if sid.min() != first[0]:
                    yield sid.min(keepdims=True), first[:1]
        yield from _pair_batches(found())

    rows = members.select("key", F.col("chunk").cast("bigint"), "sid", "n_shingles", "bits", "sketch", "first")
    rows = rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "n_shingles", "sid")
    return map_arrow(rows, run, "a bigint, b bigint", release=True).distinct()


def _open_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Round two: all surviving pairs between different components, for each pair of blocks."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for block in _blocks(parts, 3):
                i, j = block.column(1)[0].as_py(), block.column(2)[0].as_py()
                chunk, sid, size, root = (block.column(k).to_numpy() for k in (3, 4, 5, 8))
                bits, sketch = _bitmaps(block.column(6)), _sketches(block.column(7))
                sides = [np.flatnonzero(chunk == k) for k in dict.fromkeys((i, j))]
                if not all(map(len, sides)):
                    continue
                trees = [build_tree(bits[s], size[s], root[s], [sketch[k] for k in s]) for s in sides]
                x, y, _ = dual_traversal(trees[0], trees[-1], percent, other_root=True)
                yield sid[sides[0][x]], sid[sides[-1][y]]
        yield from _pair_batches(found())

    cut = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    rows = cut.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk",
                      "sid", "n_shingles", "bits", "sketch", "root")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n_shingles", "sid")
    return map_arrow(rows, run, "a bigint, b bigint", release=True).distinct()


# --- the join --------------------------------------------------------------------------------

def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs that are linked, by the overlap of their full sets.  Wide bitmaps are
    compared first, so that token lists move only for pairs that they do not exclude."""
    likely = cut_lineage_of(docs.sparkSession, lambda: _within_wide_bound(
        pairs, _rows_of(pairs, sets, docs, n, wide=True), percent), "join-likely")
    tokens = _rows_of(likely, sets, docs, n)
    one, two = tokens.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")), tokens.select(
        F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    both = likely.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", common.alias("i"), (F.size("ta") + F.size("tb") - common).alias("u")).filter(
        F.col("i").cast("bigint") * 100 >= F.col("u").cast("bigint") * percent).select("a", "b")


def _within_wide_bound(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            m, k = part.column(2).to_pylist(), part.column(4).to_pylist()
            fine = [wide_overlap(x.as_py(), y.as_py(), p, q) * (100 + percent) >= percent * (p + q)
                    for x, y, p, q in zip(part.column(3), part.column(5), m, k, strict=True)]
            yield part.select([0, 1]).filter(pa.array(fine, pa.bool_()))

    one = wide.select(F.col("sid").alias("a"), F.col("size").alias("m"), F.col("bitmap").alias("x"))
    two = wide.select(F.col("sid").alias("b"), F.col("size").alias("n"), F.col("bitmap").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "m", "x", "n", "y")
    return map_arrow(both, run, "a bigint, b bigint", release=True)


def linked_sets(sets: DataFrame, docs: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """(node, root) of the sets that are linked with another.  ``sets``: (sid, n_shingles,
    keys, bits, sketch, min_id), one row for each distinct set."""
    keyed = sets.select("sid", F.explode("keys").alias("key"))
    live = cut_lineage(keyed.groupBy("key").count().filter("count > 1").select("key"), "join-live")
    likely = with_member_flag(keyed, cut_lineage(bitmap_of(live, F.col("key"), KEY_BITS), "join-key-bits"), F.col("key"),
                              "hit", KEY_BITS).filter("hit").drop("hit")
    keyed = cut_lineage(likely.join(live, "key", "left_semi"), "join-keyed")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("first"),
                                      F.max("sid").alias("last"), F.bit_xor(F.xxhash64("sid")).alias("who"))
    # keys with the same members need one look only
    shared = cut_lineage(shared.groupBy("n", "first", "last", "who").agg(F.min("key").alias("key")), "join-shared")
    twos = shared.filter("n = 2").select(F.col("first").alias("a"), F.col("last").alias("b"))
    many = shared.filter("n > 2").select("key", "first", F.ceil(F.col("n") / block).cast("bigint").alias("chunks"))
    sizes = sets.select("sid", "n_shingles")
    members = cut_lineage(keyed.join(many, "key").join(sizes, "sid").withColumn(
        "chunk", F.pmod(F.xxhash64("sid"), F.col("chunks"))), "join-members")
    bits = sets.select("sid", "bits", "sketch")

    first = _within_bound(twos, sets, percent).unionByName(_proposals(members.join(bits, "sid"), percent))
    first = cut_lineage(first.distinct(), "join-pairs")
    spark = docs.sparkSession
    links = cut_lineage_of(spark, lambda: _verified(first, sets, docs, n, percent), "join-links")
    roots = cut_lineage(components(links), "join-roots")
    rooted = members.join(roots, F.col("sid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sid"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high")
    rooted = rooted.join(open_keys, "key", "left_semi").join(bits, "sid")
    second = cut_lineage(_open_pairs(rooted, percent).join(first, ["a", "b"], "left_anti"), "join-more-pairs")
    if second.isEmpty():
        return roots
    more = cut_lineage_of(spark, lambda: _verified(second, sets, docs, n, percent), "join-more-links")
    return components(links.unionByName(more))


def _within_bound(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (of keys with two sets) that the bound of two leaves does not exclude."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            a, b, m, n = (part.column(k).to_numpy() for k in range(4))
            x, y = (build_tree(_bitmaps(part.column(k)), size, size, _sketches(part.column(k + 2)))[0]
                    for k, size in ((4, m), (5, n)))
            at = np.arange(len(a))
            fine = overlap_by_sketch(x, y, at, at, most_overlap(x, y, at, at)) * (100 + percent) >= percent * (m + n)
            yield pa.record_batch([pa.array(a[fine]), pa.array(b[fine])], schema=_PAIR)

    one = sets.select(F.col("sid").alias("a"), F.col("n_shingles").alias("m"), F.col("bits").alias("x"),
                     F.col("sketch").alias("sx"))
    two = sets.select(F.col("sid").alias("b"), F.col("n_shingles").alias("n"), F.col("bits").alias("y"),
                     F.col("sketch").alias("sy"))
    both = pairs.join(one, "a").join(two, "b")
    return map_arrow(both.select("a", "b", "m", "n", "x", "y", "sx", "sy"), run, "a bigint, b bigint", release=True)


def _rows_of(pairs: DataFrame, sets: DataFrame, docs: DataFrame, n: int, wide: bool = False) -> DataFrame:
    """``_token_rows`` of the sets in ``pairs``, read again from their documents."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    sources = cut_lineage(involved.join(sets.select("sid", "min_id"), "sid"), "join-involved")
    likely = with_member_flag(docs, cut_lineage(bitmap_of(sources, F.col("min_id")), "join-doc-bits"),
                              F.col("doc_id"), "hit").filter("hit")
    return cut_lineage(_token_rows(likely, n, wide).join(sources.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]),
                       "join-tokens")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, tag (a hash of the text), n_shingles, component_id (the
    smallest id that links lead to, its own included)."""
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return _near_duplicates(docs, id_col, text_col, words, percent, block)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, block: int) -> DataFrame:
    named = docs.select(field(id_col).cast("bigint").alias("doc_id"), F.xxhash64(field(text_col)).alias("tag"),
                        field(text_col).alias("text"))
    rows = cut_lineage(_set_rows(named, words, percent), "join-sets")
    by_set = rows.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("min_id"), F.count(F.lit(1)).alias("n"))
    copied = cut_lineage(by_set.filter("n > 1"), "join-copied")
    likely = with_member_flag(rows.filter("sid IS NOT NULL").select("doc_id", "sid", "n_shingles", "keys", "bits", "sketch"),
                              cut_lineage(bitmap_of(copied, F.col("sid")), "join-copy-bits"), F.col("sid"), "copy")
    columns = ["sid", "n_shingles", "keys", "bits", "sketch"]
    single = likely.filter(~F.col("copy")).select(*columns, F.col("doc_id").alias("min_id"))
    chance = likely.filter("copy").join(copied, "sid", "left_anti").select(*columns, F.col("doc_id").alias("min_id"))
    # of copies only rows with the smallest id move on
    first = (likely.filter("copy").join(copied, [likely["sid"] == copied["sid"], likely["doc_id"] == copied["min_id"]])
             .select(*[likely[c] for c in columns], "min_id").dropDuplicates(["sid"]))
    sets = single.unionByName(chance).unionByName(first)
    roots = cut_lineage_of(docs.sparkSession, lambda: linked_sets(sets, named, words, percent, block), "join-components")

    # sets that are linked or copied have another component than their own row's id, maybe
    total = rows.count()
    sized = roots.join(by_set, roots["node"] == by_set["sid"]).select("sid", "root", "min_id", "n")
    smallest = sized.groupBy("root").agg(F.min("min_id").alias("component_id"))
    target = sized.join(smallest, "root").select("sid", "component_id", "n").unionByName(
        copied.join(roots, copied["sid"] == roots["node"], "left_anti").select("sid", F.col("min_id").alias("component_id"), "n"))
    target = cut_lineage(target, "join-targets")
    narrow = rows.select("doc_id", "tag", "n_shingles", "sid")
    moved = with_member_flag(narrow, cut_lineage(bitmap_of(target, F.col("sid")), "join-target-bits"), F.col("sid"), "hit")
    own = moved.filter(~F.col("hit")).unionByName(
        moved.filter("hit").join(target, "sid", "left_anti").select(*moved.columns))
    out = ["doc_id", "tag", "n_shingles", "component_id"]
    return own.withColumn("component_id", F.col("doc_id")).select(*out).unionByName(
        join_by_key(moved.filter("hit").drop("hit"), target, "sid", "n", total).select(*out))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
             percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the
    smallest id stays (with a null id: all).  Only rows that may go are moved."""
    drop = cut_lineage_of(docs.sparkSession, lambda: near_duplicates(docs, id_col, text_col, words, percent, block).filter(
        F.col("doc_id") != F.col("component_id")).select("doc_id", "tag").distinct(), "join-dropped")
    rows = docs.select(whole_row(docs).alias("row"), field(id_col).cast("bigint").alias("doc_id"),
                       F.xxhash64(field(text_col)).alias("tag"))
    flagged = with_member_flag(rows, cut_lineage(bitmap_of(drop, F.col("doc_id")), "join-drop-bits"), F.col("doc_id"), "hit")
    kept = flagged.filter("hit").join(drop, ["doc_id", "tag"], "left_anti").select("row")
    return unpack(flagged.filter(~F.col("hit")).select("row").unionByName(kept), docs.columns)


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n_shingles, list_sort(list_transform(sh, lambda x: hash(x))) AS hs FROM s),
u AS (SELECT hs, min(doc_id) AS rep, any_value(n_shingles) AS n FROM n WHERE n_shingles > 0 GROUP BY hs),
p AS (SELECT rep, n, unnest(hs[1:n - (90 * n + 99) // 100 + 1]) AS h FROM u),
c AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.h = b.h AND a.rep < b.rep
      AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
l AS (SELECT c.a, c.b FROM c JOIN u x ON x.rep = c.a JOIN u y ON y.rep = c.b
      WHERE 190 * len(list_intersect(x.hs, y.hs)) >= 90 * (x.n + y.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS x, rep AS root FROM u UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.x WHERE r.root < e.b),
m AS (SELECT x, min(root) AS root FROM r GROUP BY x)
SELECT n.doc_id, CAST(n.n_shingles AS BIGINT) AS n_shingles, coalesce(m.root, n.doc_id) AS component_id
FROM n LEFT JOIN u ON n.hs = u.hs LEFT JOIN m ON m.x = u.rep
"""
