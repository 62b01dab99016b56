"""Words of UTF-8 texts as numpy arrays, a few megabytes at a time.

Words are ``[^\\x20\\x09-\\x0D]+``; in UTF-8 the separators are single bytes, so all
work is on bytes.  A word's hash is a 64-bit polynomial over its bytes, mixed with its
length: equal words always get equal hashes, unequal ones differ except with a chance
of about 2**-64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BATCH_BYTES = 1 << 20
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15                        # odd, so that it has an inverse mod 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


class Words(NamedTuple):
    """Words of consecutive texts: ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray     # bytes of all texts, each followed by a line feed
    text_at: np.ndarray  # where each text begins in data; one more at the end
    start: np.ndarray    # word boundaries in data, end exclusive
    end: np.ndarray
    first: np.ndarray


def each(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a binary column one by one, so that no second copy of it is held."""
    return (v.as_py() for v in column)


def batches(texts: Iterable[bytes | None], limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of runs of about ``limit`` bytes; null as empty."""
    run: list[bytes] = []
    begin = held = 0
    for i, t in enumerate(texts):
        t = t or b""
        if run and held + len(t) > limit:
            yield begin, run
            run, begin, held = [], i, 0
        run.append(t)
        held += len(t) + 1
    if run:
        yield begin, run


def find_words(texts: Sequence[bytes]) -> Words:
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    text_at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=text_at[1:])
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(space, prepend=True))  # data ends with a space, so edges pair up
    start, end = edges[0::2], edges[1::2]
    return Words(data, text_at, start, end, np.searchsorted(start, text_at))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * BATCH_BYTES + 2)
        with np.errstate(over="ignore"):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            have = np.multiply.accumulate(steps)
        if size <= 4 * BATCH_BYTES:  # larger ones are for a single text and not kept
            _powers[base] = have
    return have[:n]


def forget_powers() -> None:
    _powers.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(w: Words, lower: bool = False) -> np.ndarray:
    """One uint64 for each word; ``lower`` folds A-Z (and nothing else) first."""
    if not len(w.start):
        return np.zeros(0, dtype=np.uint64)
    data = _LOWER[w.data] if lower else w.data
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    span = (sums[w.end] - sums[w.start]) * _power(_INVERSE, len(data))[w.start]
    return mix(span + (w.end - w.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words (order matters); a run that would
    cross the end is absent.  Runs that cross from one text to the next are the caller's
    to drop."""
    count = max(0, len(h) - n + 1)
    return _fold([h[i:i + count] for i in range(n)], n)


def hash_runs_at(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The same hashes for the runs that begin at the given places."""
    return _fold([h[at + i] for i in range(n)], n)


def _fold(columns: list[np.ndarray], n: int) -> np.ndarray:
    out = np.full(len(columns[0]), n, dtype=np.uint64)
    for c in columns:
        out = (out ^ c) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return mix(out)


def cut(text: bytes, limit: int = BATCH_BYTES) -> Iterator[bytes]:
    """The text in pieces of about ``limit`` bytes, each but the first beginning with a space."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + limit)
        while stop < len(text) and text[stop] not in SPACES:
            stop += 1
        yield text[at:stop]
        at = stop


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """Word hashes of one text of any length; memory stays near 8 bytes a word."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    return np.concatenate([hash_words(find_words([piece]), lower) for piece in cut(text)])


def hashed_texts(texts: Iterable[bytes | None], lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, word hashes, first) for runs of texts, as in Words."""
    for begin, run in batches(texts):
        if len(run) == 1 and len(run[0]) > 2 * BATCH_BYTES:
            h = word_hashes(run[0], lower)
            yield begin, h, np.array([0, len(h)])
        else:
            w = find_words(run)
            yield begin, hash_words(w, lower), w.first


def runs_within(first: np.ndarray, n: int) -> np.ndarray:
    """For all texts at once: start positions of runs of ``n`` words inside one text."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, dtype=np.int64)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)  # words from here to its text's end
    return np.flatnonzero(left[: total - n + 1] >= n)
