"""Periodic runs in the words of whole texts, from longest common extensions.

A run is a stretch of consecutive words with smallest period q (words q apart are equal),
at least ``min_length`` words and ``exponent`` periods long, that no neighbouring word
extends keeping the period.

For each period p the pairs (i, i + p) on a grid are extended both ways.  A run with
period p holds at least step(p) = max(min_length, exponent * p) - p consecutive equal
pairs, so a grid of that step meets every run; the grids of all periods together have
about n * ln(n) / (exponent - 1) points (a harmonic sum).  A stretch that a divisor of
p fills is found with that divisor too, with the same ends; the smallest period stays.
(With two periods or more in a stretch, its smallest period divides every other.)

Extensions come from a difference cover: residues modulo 31 such that any two positions
reach sampled ones after the same few words (30 at most).  Those few words are compared
one by one, which settles nearly all pairs; the rest is a range minimum over the
common-prefix lengths of the sorted sampled suffixes.  Only these 6 of 31 suffixes are
sorted, by two words at a time up to 31, then by doubling ranks; groups of one are left
alone.  Backward extensions use the same on the reversed words.

Texts are taken in batches of about a megabyte; each text is closed by a symbol of its
own, so that nothing extends across texts.  Memory is a fixed amount for each word of the
batch or of the longest text.  Words are compared by 64-bit hashes.

Defined results: a null or empty text, or one without words, has no runs and an empty
collapsed text; repeated rows and ids give repeated results; ids are carried as they are,
null included; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collapse_space, field, map_arrow
from .words import each, hashed_texts

MIN_LENGTH = 6
EXPONENT = 4
PAIRS = 1 << 19     # grid pairs looked at together

# A difference cover, every residue modulo 31 is a difference of two of these.
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)

_OPEN = np.iinfo(np.int32).max


def _shifts() -> np.ndarray:
    """[difference, residue]: the fewest words after which both positions are sampled."""
    sampled = np.zeros(MODULUS, dtype=bool)
    sampled[list(COVER)] = True
    out = np.full((MODULUS, MODULUS), MODULUS, dtype=np.int64)
    at = np.arange(MODULUS)
    for h in range(MODULUS - 1, -1, -1):
        both = sampled[(at[None, :] + h) % MODULUS] & sampled[(at[None, :] + at[:, None] + h) % MODULUS]
        out[both] = h
    return out


_SHIFT = _shifts()
_SLOT = np.zeros(MODULUS, dtype=np.int64)
_SLOT[list(COVER)] = np.arange(len(COVER))


def _sample(at: np.ndarray) -> np.ndarray:
    """Index of a sampled position among all sampled positions."""
    return at // MODULUS * len(COVER) + _SLOT[at % MODULUS]


class RangeMinimum:
    """Minimum of ``values[lo:hi + 1]`` from a sparse table."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), dtype=np.int64)
        for k in np.unique(level):
            here = level == k
            row = self.levels[k]
            out[here] = np.minimum(row[lo[here]], row[hi[here] - (1 << int(k)) + 1])
        return out


class Extensions:
    """Longest common extensions in an array of symbols in which every text ends with a
    symbol that occurs nowhere else, the array's last symbol included."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = np.append(symbols, 0).astype(np.int64)
        self.rank: np.ndarray | None = None

    def _sort(self) -> None:
        """Sort the sampled suffixes; ``rank`` by sample, ``lcp`` with the one before."""
        s = self.symbols
        n = len(s) - 1
        at = (np.arange(-(-n // MODULUS))[:, None] * MODULUS + np.array(COVER)).ravel()
        at = at[at < n]
        m = len(at)
        order, rank = np.arange(m), np.zeros(m, dtype=np.int64)
        lcp = np.full(m, _OPEN, dtype=np.int32)
        slots = np.arange(m) if m > 1 else np.zeros(0, dtype=np.int64)   # places in groups of two or more
        depth = 0
        while len(slots):
            here = order[slots]
            if depth < MODULUS:
                step = min(2, MODULUS - depth)
                key = s[at[here] + depth] << 32
                if step == 2:
                    key |= s[at[here] + depth + 1]
            else:
                step = depth
                key = rank[_sample(at[here] + depth)]
            group = rank[here]
            sort = np.lexsort((key, group))
            here, key, group = here[sort], key[sort], group[sort]
            order[slots] = here
            new = np.ones(len(slots), dtype=bool)
            new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
            split = np.flatnonzero(new[1:] & (group[1:] == group[:-1])) + 1
            if len(split):
                a, b = key[split - 1], key[split]
                if depth < MODULUS:
                    lcp[slots[split]] = depth + (((a ^ b) >> 32 == 0) & (step == 2))
                else:      # different groups of this depth: all minima between them are known
                    lcp[slots[split]] = depth + RangeMinimum(lcp)(a + 1, b)
            rank[here] = np.maximum.accumulate(np.where(new, slots, 0))
            alone = new & np.append(new[1:], True)
            slots = slots[~alone]
            depth += step
        self.rank, self.minimum = rank, RangeMinimum(lcp)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of different positions the number of equal symbols from there on."""
        s = self.symbols
        i, j = np.minimum(i, j), np.maximum(i, j)
        need = _SHIFT[(j - i) % MODULUS, i % MODULUS]
        out = np.zeros(len(i), dtype=np.int64)
        live = np.arange(len(i))
        synced = []
        for k in range(MODULUS):
            ready = need[live] == k
            if ready.any():
                synced.append(live[ready])
                live = live[~ready]
            same = s[i[live] + k] == s[j[live] + k]
            out[live[~same]] = k
            live = live[same]
            if not len(live):
                break
        if synced:
            if self.rank is None:
                self._sort()
            at = np.concatenate(synced)
            a, b = self.rank[_sample(i[at] + need[at])], self.rank[_sample(j[at] + need[at])]
            out[at] = need[at] + self.minimum(np.minimum(a, b) + 1, np.maximum(a, b))
        return out


def _grid(sizes: np.ndarray, ends: np.ndarray, min_length: int, exponent: int,
          limit: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, period) of all grid pairs, a bounded number at a time.  ``sizes`` falls, so the
    texts long enough for a period fill the array up to one of ``ends``."""
    if not len(sizes):
        return
    top = int(sizes[0]) // exponent
    for begin in range(1, top + 1, limit):
        p = np.arange(begin, min(top + 1, begin + limit))
        shortest = np.maximum(min_length, exponent * p)
        long_enough = np.searchsorted(-sizes, -shortest, side="right")
        p, shortest, long_enough = (x[long_enough > 0] for x in (p, shortest, long_enough))
        step = shortest - p
        count = -(-np.maximum(0, ends[long_enough - 1] - p) // step)
        total = np.cumsum(count)
        for chunk in range(0, int(total[-1]) if len(total) else 0, limit):
            k = np.arange(chunk, min(chunk + limit, int(total[-1])))
            which = np.searchsorted(total, k, side="right")
            yield (k - (total[which] - count[which])) * step[which], p[which]


def find_runs(hashes: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH,
              exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period; the words of
    text t are ``hashes[first[t]:first[t + 1]]``."""
    if exponent < 2 or min_length < 2:
        raise ValueError("a run has at least two words and two periods")
    sizes = np.diff(first)
    texts = np.argsort(-sizes, kind="stable")
    texts = texts[sizes[texts] >= min_length]
    none = np.zeros(0, dtype=np.int64)
    if not len(texts):
        return none, none, none, none
    sizes = sizes[texts]
    # one closing symbol before all texts and one after each
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes
    n = int(ends[-1]) + 1
    source = np.repeat(first[:-1][texts] - starts, sizes + 1) + np.arange(1, n)
    closing = ends
    inside = np.ones(n, dtype=bool)
    inside[0] = False
    inside[closing] = False
    symbols = np.zeros(n, dtype=np.int64)
    kinds, symbols[inside] = np.unique(hashes[source[inside[1:]]], return_inverse=True)
    symbols[0] = len(kinds)
    symbols[closing] = len(kinds) + 1 + np.arange(len(texts))
    ahead, back = Extensions(symbols), Extensions(symbols[::-1])
    found = []
    for i, p in _grid(sizes, ends, min_length, exponent):
        i = i + 1
        same = np.flatnonzero(symbols[i] == symbols[np.minimum(i + p, n - 1)])
        i, p = i[same], p[same]
        i, p = i[i + p < n], p[i + p < n]
        step = np.maximum(min_length, exponent * p) - p
        f = ahead(i, i + p)
        # the words before i and i + p, in the reversed array
        b = back(n - i, n - i - p)
        good = f + b >= step
        i, p, f, b = i[good], p[good], f[good], b[good]
        found.append(np.stack([i - b, f + b + p, p]))
    start, length, period = np.concatenate(found, axis=1) if found else (none, none, none)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    least = np.ones(len(start), dtype=bool)      # of equal stretches the one with the smallest period
    least[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[least], length[least], period[least]
    at = np.searchsorted(starts, start, side="right") - 1
    text, start = texts[at], start - starts[at]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def collapse(text: bytes, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    words = text.split()      # splits bytes at exactly the six separators
    if len(start):
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        words = compress(words, np.cumsum(edge[:-1]) == 0)
    return b" ".join(words)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period by start, then
    period; starts are word numbers from 0) and the collapsed text."""
    narrow = docs.select(field(id_col).alias("doc_id"), F.coalesce(field(text_col), F.lit("")).cast("binary").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column(1)
            for begin, hashes, first in hashed_texts(each(column)):
                n = len(first) - 1
                text, start, length, period = find_runs(hashes, first, min_length, exponent)
                at = np.searchsorted(text, np.arange(n + 1))
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUN))
                collapsed = [collapse(column[begin + k].as_py(), *(x[at[k]:at[k + 1]] for x in (start, length, period)))
                             for k in range(n)]
                yield pa.record_batch(
                    [part.column(0).slice(begin, n), pa.array(np.diff(first), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs), pa.array(collapsed, pa.binary())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    out = map_arrow(narrow, run, f"doc_id {kind}, n_words bigint, "
                                 "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    return out.select("doc_id", "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def run_digest(found: DataFrame) -> DataFrame:
    """Per document the number of runs, its greatest run (ties: smallest start, then
    period) and the hashes of the list of runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select("doc_id", "n_words", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
                        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_words", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): of each id whose crc32 h ends in 0, the words from a = g % n on repeat
    the first p = 1 + (n - a) div (3 + g % 8) of them, with g = h div 10.  Other texts, those
    without words and those without an id stay as they are."""
    d = docs.select(field(id_col).alias("doc_id"), field(text_col).alias("text"),
                    F.crc32(field(id_col).cast("string")).alias("h"))
    d = d.withColumn("flat", F.when(F.col("h") % 10 == 0, F.trim(collapse_space(F.col("text")))))
    d = d.withColumn("w", F.when(F.col("flat") != "", F.split("flat", " ")))
    d = d.withColumn("n", F.size("w").cast("bigint")).withColumn("g", F.expr("h div 10"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    d = d.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    woven = F.expr("concat(slice(w, 1, int(a)), slice(flatten(array_repeat(slice(w, int(a) + 1, int(p)), "
                   "int((n - a + p - 1) div p))), 1, int(n - a)))")
    text = F.when(F.col("n") > 0, F.array_join(woven, " ")).otherwise(F.col("text"))
    return d.select("doc_id", text.alias("text"))
