"""Periodic runs: against plain comparison of words at every distance."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from odd_rows import none, odd, odd_docs, words  # noqa: F401

from ledgerlens.llm import periods
from ledgerlens.llm.queries import op11_periodic_runs

SMALL = "/root/testdata/sf0.001"


def plain_runs(w, min_length=6, exponent=4):
    """(start, length, period) by comparing all words at every distance."""
    ids = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in w])
    found = {}
    for p in range(1, len(w) // exponent + 1):
        same = np.concatenate([[False], w[:-p] == w[p:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            if j - i + p >= max(min_length, exponent * p):
                found.setdefault((i, j - i + p), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def planted(doc_id, text):
    w = words(text)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_digest(doc_id, text):
    w = planted(doc_id, text)
    runs = plain_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    s, n, p = min(((s, n, p) for s, n, p in runs), key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(w), len(runs), s, n, p, 1000 * n // p if p else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def random_text(rng, k, n):
    w = [f"w{rng.randrange(k)}" for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // rng.choice([3, 4, 5, 9])))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)] + w[: rng.randrange(20)]
    return w


@pytest.mark.parametrize(("min_length", "exponent"), [(6, 4), (2, 2), (7, 3)])
def test_runs_of_random_texts(min_length, exponent):
    rng = random.Random(exponent)
    for _ in range(60):
        texts = [random_text(rng, rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 1, 5, 6, 7, 30, 100, 400]))
                 for _ in range(rng.randrange(1, 8))]
        first = np.cumsum([0] + [len(t) for t in texts])
        hashes = np.array([zlib.crc32(x.encode()) for t in texts for x in t], dtype=np.uint64)
        text, *rest = periods.find_runs(hashes, first, min_length, exponent)
        got = [[tuple(int(x[k]) for x in rest) for k in np.flatnonzero(text == t)] for t in range(len(texts))]
        assert got == [plain_runs(t, min_length, exponent) for t in texts]


def test_nested_and_touching_runs():
    square = "a b a b a b a b a c ".split()
    w = square * 5 + ["z"] * 9 + ["z", "y"] * 6
    first = np.array([0, len(w)])
    _, *rest = periods.find_runs(np.array([ord(x) for x in w], dtype=np.uint64), first)
    got = list(zip(*(x.tolist() for x in rest), strict=True))
    assert got == plain_runs(w) and len({p for _, _, p in got}) == 3


def test_grid_in_small_chunks():
    sizes = np.array([90, 40, 40, 7])
    ends = np.cumsum(sizes + 1)
    whole = list(periods._grid(sizes, ends, 6, 4))
    parts = list(periods._grid(sizes, ends, 6, 4, limit=7))
    assert all(len(i) <= 7 for i, _ in parts)
    pairs = lambda x: sorted((int(a), int(b)) for i, p in x for a, b in zip(i, p, strict=True))
    assert pairs(whole) == pairs(parts)


def test_extensions_reach_far_apart_positions():
    rng = np.random.default_rng(3)
    block = rng.integers(0, 3, 200)
    s = np.concatenate([block, block, block[:150], [9], block, [10]])
    extend = periods.Extensions(s)
    i, j = rng.integers(0, len(s), (2, 4000))
    i, j = i[i != j], j[i != j]

    def plain(a, b):
        k = 0
        while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
            k += 1
        return k
    assert extend(i, j).tolist() == [plain(a, b) for a, b in zip(i, j, strict=True)]


def test_odd_rows(odd):
    got = periods.run_digest(periods.periodic_runs(periods.with_planted_periods(odd))).collect()
    assert Counter(map(tuple, got)) == Counter(plain_digest(i, t) for i, t, *_ in odd_docs())


def test_runs_of_the_given_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    got = Counter(map(tuple, op11_periodic_runs(spark, SMALL).collect()))
    assert got == Counter(plain_digest(i, t) for i, t in rows)


def test_texts_and_other_columns(spark, none):
    odd_names = spark.createDataFrame([("k1", "x y x y x y x y x z", "runs")], "`a.b` string, collapsed string, runs string")
    got = periods.periodic_runs(odd_names, "a.b", "collapsed").first()
    assert (got.doc_id, got.collapsed) == ("k1", "x y z") and [tuple(r) for r in got.runs] == [(0, 9, 2)]
    empty = periods.run_digest(periods.periodic_runs(periods.with_planted_periods(none)))
    assert empty.count() == 0 and empty.columns[:2] == ["doc_id", "n_words"]
    with pytest.raises(ValueError):
        periods.find_runs(np.zeros(3, dtype=np.uint64), np.array([0, 3]), exponent=1)
