"""Quality rules: fixed rules, then gradient-boosted trees over document statistics.

The statistics come from one vectorised pass over each batch of texts.  The trees are
trained on a bounded sample of labelled documents (``sample_rows``, the labelled ids
with the smallest hashes): histogram splits, logistic loss, and monotonic constraints on
chosen features (more symbols, duplicate lines or repeated words never raise the score).
The fitted trees are flattened into numpy node arrays, and scoring walks all trees for
a batch of rows at once.  Everything but the fit covers all rows; a row's verdict
depends on its own text and the model only.

Defined results: a null text has no words; texts without words, and all others that fail
a fixed rule, are not kept.  Labels that are null, or of ids absent from the documents,
are ignored.  Without labels of both classes there is no model, and the fixed rules
alone decide.  Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, map_arrow
from .words import BATCH_BYTES, batches, cut, each, find_words, hash_runs, hash_words, mix, runs_within

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SAMPLE_ROWS = 20_000
THRESHOLD = 0.5

# --- statistics -------------------------------------------------------------------

_CLASSES = {  # bytes of each counted class
    "symbols": b"#*$%&|<>",
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digits": b"0123456789",
    "marks": b"!\"'(),-./:;?@[\\]_`{}~+=^",
    "lines": b"\n",
}
_MASKS = {k: np.isin(np.arange(256), list(v)).astype(np.uint8) for k, v in _CLASSES.items()}
_CONTINUES = ((np.arange(256) & 0xC0) == 0x80).astype(np.uint8)
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]).astype(np.uint8)
_WIDE = (np.arange(256) >= 0xC0).astype(np.uint8)   # first bytes of code points beyond ASCII

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct",
          "n_upper", "n_lower", "n_digits", "n_marks", "n_wide")
FEATURES = ("words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share",
            "upper_share", "digit_share", "mark_share", "wide_share", "words_per_line")
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    lines = [x for x in text.split(b"\n") if x.strip()]   # bytes.strip: the six ASCII spaces
    return len(lines), len(lines) - len(set(lines))


def repeated_words(h: np.ndarray, first: np.ndarray, n: int = 3) -> np.ndarray:
    """For each text, its words in runs of ``n`` words that occur twice or more in it."""
    at = runs_within(first, n)
    marks = np.zeros(len(h) + 1, dtype=np.int64)
    if len(at):
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))[at]
        key = mix(hash_runs(h, n)[at] ^ mix(text.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
        twice = at[order[np.append(same, False) | np.insert(same, 0, False)]]
        covered = np.zeros(len(h), dtype=bool)
        for i in range(n):
            covered[twice + i] = True
        np.cumsum(covered, out=marks[1:])
    return marks[first[1:]] - marks[first[:-1]]


def _sums(mask: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(mask, begin, dtype=np.int64)


def _bytes_counts(data: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
    c = {k: _sums(m[data], begin) for k, m in _MASKS.items()}
    c["chars"] = _sums((_SPACE[data] | _CONTINUES[data]) ^ 1, begin)   # code points that are no space
    c["wide"] = _sums(_WIDE[data], begin)
    return c


def text_counts(texts: Sequence[bytes]) -> np.ndarray:
    """One row of COUNTS for each text of a batch."""
    if len(texts) == 1 and len(texts[0]) > 2 * BATCH_BYTES:   # in pieces: the counts add up
        parts, hashes = [], []
        for piece in cut(texts[0]):
            w = find_words([piece])
            parts.append(_bytes_counts(w.data, w.text_at[:-1]))
            hashes.append(hash_words(w))
        c = {k: sum(p[k] for p in parts) for k in parts[0]}
        h = np.concatenate(hashes)
        first = np.array([0, len(h)])
    else:
        w = find_words(texts)
        c = _bytes_counts(w.data, w.text_at[:-1])
        h, first = hash_words(w), w.first
    lines = np.array([duplicate_lines(t) for t in texts], dtype=np.int64).reshape(-1, 2)
    distinct = [len(np.unique(h[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]
    return np.column_stack([np.diff(first), c["chars"], c["symbols"], lines[:, 1], repeated_words(h, first),
                            lines[:, 0], distinct, c["upper"], c["lower"], c["digits"], c["marks"], c["wide"]])


def features(counts: np.ndarray) -> np.ndarray:
    c = {k: counts[:, i].astype(np.float64) for i, k in enumerate(COUNTS)}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    letters = np.maximum(c["n_upper"] + c["n_lower"] + c["n_wide"], 1)
    lines = np.maximum(c["n_lines"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, c["n_distinct"] / words, c["n_upper"] / letters, c["n_digits"] / chars,
        c["n_marks"] / chars, c["n_wide"] / letters, words / lines])


def base_failed(counts: np.ndarray) -> np.ndarray:
    n, repeated = counts[:, 0], counts[:, 4]
    return (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)


# --- trees ------------------------------------------------------------------------

class Forest(NamedTuple):
    """All trees in flat node arrays; a leaf points to itself, so a walk of ``depth``
    steps ends on a leaf from anywhere."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.root, (len(x), len(self.root))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go_left = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(go_left, self.left[node], self.right[node])
        return self.bias + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


@dataclass(frozen=True)
class Boosting:
    trees: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    smoothing: float = 1.0    # added to the hessian of every node
    least_rows: int = 20      # in a leaf


def fit_forest(x: np.ndarray, y: np.ndarray, monotone: Sequence[int], how: Boosting = Boosting()) -> Forest:
    """Boosted trees for labels 0/1.  ``monotone`` has +1, -1 or 0 for each feature: with
    +1 the score never falls as the feature grows.  A split on such a feature must order
    its children's values, and the middle between them bounds all values below."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, how.bins + 1)[1:-1])) for j in range(m)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)])
    flat = binned + np.arange(m) * (how.bins + 1)
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    bias = float(np.log(p / (1 - p)))
    margin = np.full(n, bias)
    nodes: list[list] = []   # feature, threshold, left, right, value
    roots = []
    sign = np.asarray(monotone)

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    for _ in range(how.trees):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = y - q, q * (1 - q)
        root = leaf(0.0)
        roots.append(root)
        work = [(root, np.arange(n), -np.inf, np.inf, 0)]
        while work:
            node, rows, low, high, depth = work.pop()
            g, h = grad[rows].sum(), hess[rows].sum() + how.smoothing
            value = float(np.clip(g / h, low, high))
            split = None
            if depth < how.depth and len(rows) >= 2 * how.least_rows:
                size = m * (how.bins + 1)
                f = flat[rows].ravel()
                shape = (m, how.bins + 1)
                gs = np.bincount(f, np.repeat(grad[rows], m), size).reshape(shape).cumsum(1)[:, :-1]
                hs = np.bincount(f, np.repeat(hess[rows], m), size).reshape(shape).cumsum(1)[:, :-1]
                ns = np.bincount(f, minlength=size).reshape(shape).cumsum(1)[:, :-1]
                hl, hr = hs + how.smoothing, h - hs
                vl, vr = np.clip(gs / hl, low, high), np.clip((g - gs) / hr, low, high)
                # gain of a leaf with value v: 2 g v - h v^2
                gain = 2 * gs * vl - hl * vl ** 2 + 2 * (g - gs) * vr - hr * vr ** 2 - (2 * g * value - h * value ** 2)
                fine = (ns >= how.least_rows) & (len(rows) - ns >= how.least_rows) & ((vr - vl) * sign[:, None] >= 0)
                gain = np.where(fine, gain, -np.inf)
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] > 1e-6 and b < len(edges[j]):
                    split = int(j), int(b), float(vl[j, b]), float(vr[j, b])
            if split is None:
                nodes[node][4] = how.rate * value
                margin[rows] += how.rate * value
                continue
            j, b, a, c = split
            middle = (a + c) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)),
                      -1: ((middle, high), (low, middle))}[int(sign[j])]
            left, right = leaf(0.0), leaf(0.0)
            nodes[node] = [j, float(edges[j][b]), left, right, 0.0]
            goes_left = binned[rows, j] <= b
            work.append((left, rows[goes_left], *bounds[0], depth + 1))
            work.append((right, rows[~goes_left], *bounds[1], depth + 1))
    cols = list(zip(*nodes, strict=True))
    return Forest(np.array(cols[0], dtype=np.int64), np.array(cols[1], dtype=np.float64),
                  np.array(cols[2], dtype=np.int64), np.array(cols[3], dtype=np.int64),
                  np.array(cols[4], dtype=np.float64), np.array(roots, dtype=np.int64), how.depth, bias)


# --- Spark --------------------------------------------------------------------------

_COUNT_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS]])


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and COUNTS."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = part.column(0), each(part.column(1))
            for begin, batch in batches(texts):
                c = text_counts(batch)
                yield pa.record_batch([ids.slice(begin, len(batch)), *c.T.copy()], schema=_COUNT_SCHEMA)

    narrow = docs.select(field(id_col).cast("bigint").alias("doc_id"), field(text_col).cast("binary").alias("text"))
    return map_arrow(narrow, run, ", ".join(f"{f.name} bigint" for f in _COUNT_SCHEMA), release=True)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", sample_rows: int = SAMPLE_ROWS, how: Boosting = Boosting()) -> Forest | None:
    """Trees from at most ``sample_rows`` labelled documents, of rows that repeat an id the one
    with the smallest counts; None without both classes.  A document with several labels
    has the smallest (bad if any of them says so), whatever their order."""
    chosen = (labels.filter(field(label_col).isNotNull() & field(id_col).isNotNull())
              .select(field(id_col).cast("bigint").alias("doc_id"), field(label_col).cast("int").alias("y"))
              .groupBy("doc_id").agg(F.min("y").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    texts = docs.select(field(id_col).cast("bigint").alias("doc_id"), field(text_col).alias("text"))
    # the sample is bounded by its parameter, so it may be broadcast
    labelled = texts.join(F.broadcast(chosen), "doc_id")
    one = document_counts(labelled.select("doc_id", "text")).groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("c"))
    counted = one.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "c.*")
    rows = np.array([tuple(r) for r in counted.collect()], dtype=np.int64)
    if not len(rows):
        return None
    rows = rows[np.lexsort(rows.T[::-1])]   # the fit does not depend on the order of tasks
    y = (rows[:, 1] > 0).astype(np.float64)
    if y.min() == y.max():
        return None
    return fit_forest(features(rows[:, 2:]), y, [MONOTONE.get(f, 0) for f in FEATURES], how)


_OUT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS[:5]], ("base_failed", pa.bool_()),
                  ("kept", pa.bool_()), ("score", pa.float64())])


def judge(counts: np.ndarray, model: Forest | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = base_failed(counts)
    score = model.probability(features(counts)) if model else np.ones(len(counts))
    return failed, ~failed & (score >= threshold), score


def quality_verdicts(docs: DataFrame, model: Forest | None, id_col: str = "doc_id", text_col: str = "text",
                     threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, score."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = part.column(0), each(part.column(1))
            for begin, batch in batches(texts):
                c = text_counts(batch)
                failed, kept, score = judge(c, model, threshold)
                yield pa.record_batch([ids.slice(begin, len(batch)), *c.T[:5].copy(), failed, kept, score], schema=_OUT)

    narrow = docs.select(field(id_col).cast("bigint").alias("doc_id"), field(text_col).cast("binary").alias("text"))
    schema = ", ".join([f"{c} bigint" for c in ("doc_id", *COUNTS[:5])]) + ", base_failed boolean, kept boolean, score double"
    return map_arrow(narrow, run, schema)


def keep_good(docs: DataFrame, model: Forest | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; rows do not move."""
    columns = docs.columns
    at = columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = each(part.column(at).cast(pa.binary()))
            for begin, batch in batches(texts):
                _, kept, _ = judge(text_counts(batch), model, threshold)
                yield part.slice(begin, len(batch)).filter(pa.array(kept))

    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])     # names with dots do not pass mapInArrow
    return map_arrow(plain, run, plain.schema, release=True).toDF(*columns)
