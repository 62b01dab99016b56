"""Spelling variants: words one edit apart, found by blocked Gram matrices.

Words one inserted, deleted or replaced letter apart have letter-count vectors at a
squared distance of at most two, and lengths that differ by at most one.  So words are
blocked by length and by how many of their letters fall into each of a few letter
classes; an edit adds one to one class (insertion) or moves one from a class to another
(replacement), so a block meets itself and a few neighbouring blocks only.  For two
blocks a NumPy product of the count matrices gives all squared distances,
|x|^2 + |y|^2 - 2 x.y; pairs at most two apart are verified letter by letter.

The number of classes (1, 2, 4 or 8) is the least for which a word's block holds 1,000
words on average, so the work grows nearly in proportion to the vocabulary.  Blocks are
cut into tiles of about 1,024 words; each pair of tiles is one row of work, dealt by the
tile at home, so a block of any size is spread over tasks and no task holds more than two
tiles.  Nothing is dropped by block size.

Words are counted per task first, in a table that is emptied at 200,000 words, so a
frequent word costs one row for each task.  Chains from form to form are followed by
joining the table with itself, which doubles the steps; each form occurs at least
``ratio`` times as often, so chains have no cycles.  Nothing but counts reaches the driver.

Defined results: null and empty texts have no words; a null id counts as the word "null"
in the hash; repeated rows count again; an empty table, or one without words of the
wanted length and count, gives an empty result.  Words of any length are whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import field, map_arrow
from .words import each

LETTERS = "a-zÀ-ÿ"    # after A-Z are lower-cased
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
TABLE_WORDS = 200_000
SECTION = 1 << 20               # characters of a long text looked at together
TILE = 1024
BLOCK_WORDS = 1000
CLASSES = 8
DIMENSIONS = 90                 # a-z, then 64 more by code point


# --- counting ------------------------------------------------------------------

def shortened(word: str, h: int) -> str:
    """The word without its code point h % length."""
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _sections(text: str) -> Iterator[str]:
    """A long text in sections that end outside of words."""
    outside = re.compile(f"[^{LETTERS}]")
    at = 0
    while len(text) - at > SECTION:
        m = outside.search(text, at + SECTION)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                slip_every: int | None = None, table_words: int = TABLE_WORDS) -> DataFrame:
    """(word, n): occurrences of the words of at least ``min_length`` letters in all whole
    texts.  With ``slip_every``, a word of a document whose crc32 of ``<id>:<word>`` it
    divides loses the letter at that number modulo its length (planted misspellings)."""
    narrow = docs.select(F.coalesce(field(id_col).cast("string"), F.lit("null")).alias("id"),
                         F.coalesce(field(text_col), F.lit("")).cast("binary").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"[{LETTERS}]{{{min_length},}}").findall
        table: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(table.keys(), pa.string()), pa.array(table.values(), pa.int64())],
                                   names=["word", "n"])

        for part in parts:
            for id_, raw in zip(part.column(0).to_pylist(), each(part.column(1)), strict=True):
                seed = zlib.crc32(f"{id_}:".encode())
                for text in _sections(raw.lower().decode("utf-8", "replace")):   # bytes: A-Z only
                    found = Counter(find(text))
                    if slip_every:
                        for word, n in list(found.items()):
                            h = zlib.crc32(word.encode(), seed)
                            if h % slip_every == 0:
                                del found[word]
                                word = shortened(word, h)
                                if len(word) >= min_length:
                                    table[word] += n
                    table.update(found)
                    if len(table) >= table_words:
                        yield rows()
                        table.clear()
        if table:
            yield rows()

    return map_arrow(narrow, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# --- near pairs ------------------------------------------------------------------

def dimension(codes: np.ndarray) -> np.ndarray:
    """The count vector's place of each code point; sharing one only lessens distances."""
    ascii_ = (codes >= 97) & (codes <= 122)
    return np.where(ascii_, codes - 97, 26 + codes % 64).astype(np.int64)


def letter_matrix(words: list[str], length: int) -> np.ndarray:
    """One row of code points for each of the words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), length)


def count_matrix(codes: np.ndarray) -> np.ndarray:
    rows = np.arange(len(codes))[:, None] * DIMENSIONS
    counts = np.bincount((rows + dimension(codes)).ravel(), minlength=len(codes) * DIMENSIONS)
    exact = np.float32 if codes.shape[1] < 2000 else np.float64     # squares below 2**24
    return counts.reshape(len(codes), DIMENSIONS).astype(exact)


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) of the rows of two letter matrices that are one edit apart; the words
    of ``b`` are as long or one longer.  ``same``: both are one tile, take i < j."""
    x, y = count_matrix(a), count_matrix(b)
    squared = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    if same:
        squared[np.tril_indices(len(a))] = 9
    i, j = np.nonzero(squared <= 2)
    keep = np.zeros(len(i), dtype=bool)
    part = max(1, (1 << 20) // a.shape[1])
    for at in range(0, len(i), part):       # bounded memory for blocks of many anagrams
        left, right = a[i[at:at + part]], b[j[at:at + part]]
        if a.shape[1] == b.shape[1]:
            keep[at:at + part] = (left != right).sum(1) == 1
        else:   # equal letters from the front and, one apart, from the back cover the shorter word
            front = np.logical_and.accumulate(left == right[:, :-1], axis=1).sum(1)
            back = np.logical_and.accumulate((left == right[:, 1:])[:, ::-1], axis=1).sum(1)
            keep[at:at + part] = front + back >= a.shape[1]
    return i[keep], j[keep]


def _with_classes(words: DataFrame) -> DataFrame:
    """Adds size (letters) and classes: letters in each of 8 classes of count places."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column(0).to_pylist()
            counts = [np.bincount(dimension(letter_matrix([w], len(w))[0]) % CLASSES, minlength=CLASSES) for w in column]
            yield pa.record_batch([part.column(0), part.column(1), pa.array([len(w) for w in column], pa.int32()),
                                   pa.array([c.tolist() for c in counts], pa.list_(pa.int32()))],
                                  names=["word", "n", "size", "classes"])

    return map_arrow(words, run, "word string, n bigint, size int, classes array<int>")


def _folded(n: int) -> Column:
    """The 8 class counts folded into n, which divides 8."""
    return F.array(*[sum((F.col("classes")[k] for k in range(c + n, CLASSES, n)), F.col("classes")[c])
                     for c in range(n)])


def _class_count(words: DataFrame, block_words: int) -> int:
    for n in (1, 2, 4):
        sizes = words.groupBy("size", _folded(n).alias("key")).count()
        total, squares = sizes.agg(F.sum("count"), F.sum(F.col("count") * F.col("count"))).first()
        if total is None or squares <= block_words * total:
            return n
    return CLASSES


def _met_blocks(n: int) -> Column:
    """The blocks (size, key) that a block's words may have near words in, each pair of
    blocks from one side only: itself, one letter moved to a later class, one letter more."""
    def moved(size: int, change: dict[int, int]) -> Column:
        key = F.array(*[F.col("key")[c] + change.get(c, 0) for c in range(n)])
        return F.struct((F.col("size") + size).alias("size"), key.alias("key"))

    return F.array(moved(0, {}), *[moved(0, {a: -1, b: 1}) for a in range(n) for b in range(a + 1, n)],
                   *[moved(1, {a: 1}) for a in range(n)])


def pairs_one_edit_apart(words: DataFrame, tile: int = TILE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, near, near_n) for both directions of every pair of words one edit apart;
    ``words`` has distinct (word, n)."""
    sized = cut_lineage(_with_classes(words.select("word", "n")), "spelling-words")
    n = _class_count(sized, block_words)
    keyed = sized.withColumn("key", _folded(n))
    blocks = cut_lineage(keyed.groupBy("size", "key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")),
                         "spelling-blocks")
    tiles = cut_lineage(
        keyed.join(blocks, ["size", "key"])
        .withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
        .groupBy("size", "key", "tile").agg(F.collect_list(F.struct("word", "n")).alias("members"))
        .select("size", "key", "tile", F.col("members.word").alias("words"), F.col("members.n").alias("counts")),
        "spelling-tiles")
    visits = tiles.select(F.col("size").alias("own_size"), F.col("key").alias("own_key"), F.col("tile").alias("own_tile"),
                          F.col("words").alias("own_words"), F.col("counts").alias("own_counts"),
                          F.explode(_met_blocks(n)).alias("met"))
    visits = visits.select("*", F.col("met.size").alias("size"), F.col("met.key").alias("key")).drop("met")
    visits = visits.join(blocks, ["size", "key"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    own_block = (F.col("own_size") == F.col("size")) & (F.col("own_key") == F.col("key"))
    work = visits.join(tiles, ["size", "key", "tile"]).withColumn("same", own_block & (F.col("own_tile") == F.col("tile")))
    work = work.filter(~own_block | (F.col("own_tile") <= F.col("tile"))).select(
        "own_size", "own_words", "own_counts", "size", "words", "counts", "same")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                own_size, left, left_n, size, right, right_n, same = (part.column(c)[k].as_py() for c in range(7))
                i, j = near_pairs(letter_matrix(left, own_size), letter_matrix(right, size), same)
                if len(i):
                    a, b, an, bn = (pa.array(x).take(pa.array(at)) for x, at in
                                    ((left, i), (right, j), (left_n, i), (right_n, j)))
                    yield pa.record_batch([pa.concat_arrays([a, b]), pa.concat_arrays([b, a]),
                                           pa.concat_arrays([bn, an])], names=["word", "near", "near_n"])

    return map_arrow(work, run, "word string, near string, near_n bigint")


# --- forms and roots ----------------------------------------------------------------

def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word along its forms to the last, by doubling steps."""
    now = cut_lineage(forms.select("word", F.coalesce("form", "word").alias("up"), F.lit(True).alias("moved")), "spelling-up")
    while now.filter("moved").limit(1).count():
        above = now.select(F.col("word").alias("up"), F.col("up").alias("next"))
        now = cut_lineage(now.join(above, "up").select("word", F.col("next").alias("up"),
                                                       (F.col("next") != F.col("up")).alias("moved")), "spelling-up")
    return now.select("word", F.col("up").alias("root"))


def spelling_groups(counts: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO,
                    tile: int = TILE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per word of ``counts`` (word, n) with at least ``min_length`` letters and
    ``min_count`` occurrences: word, form (its near word of largest n, ties by code point,
    if that has ``ratio`` times its n), root, n, n_near, form_n."""
    words = cut_lineage(counts.select("word", "n").filter(
        (F.col("n") >= min_count) & (F.length("word") >= min_length)), "spelling-counts")
    near = pairs_one_edit_apart(words, tile, block_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near"))).alias("best"))
    good = -F.col("best.n") >= ratio * F.col("n")
    forms = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.n")).alias("form_n")), "spelling-forms")
    return forms.join(_roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
