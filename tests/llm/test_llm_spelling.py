"""Spelling variants: against plain Python over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from odd_rows import none, odd, odd_docs  # noqa: F401

from ledgerlens.llm import spelling
from ledgerlens.llm.queries import op13_spelling_variants

SMALL = "/root/testdata/sf0.001"


def plain_counts(rows, slip_every=97):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if slip_every and h % slip_every == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            if len(w) >= 5:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_groups(counts, ratio=2):
    """Words that are equal after one deletion in one of them or both are compared."""
    cut = {}
    for w in counts:
        for v in {w} | {w[:k] + w[k + 1:] for k in range(len(w))}:
            cut.setdefault(v, []).append(w)
    near = {w: set() for w in counts}
    for members in cut.values():
        for a in members:
            near[a].update(b for b in members if one_edit(a, b))
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return Counter((w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items())


def made_words(rng, n):
    out = set()
    while len(out) < n:
        w = "".join(rng.choice("abàÿ") for _ in range(rng.choice([5, 5, 6, 9])))
        out.update([w, w[:2] + rng.choice("abcx") + w[3:], w + "a"])
    return {w: rng.choice([3, 4, 7, 8, 20, 100, 1000]) for w in sorted(out)}


@pytest.mark.parametrize(("tile", "block_words"), [(1024, 1000), (16, 1000), (64, 100), (8, 1)])
def test_groups_of_made_words(spark, tile, block_words):
    counts = made_words(random.Random(tile), 600)
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    got = Counter(map(tuple, spelling.spelling_groups(df, tile=tile, block_words=block_words).collect()))
    want = plain_groups(counts)
    assert got == want
    assert len({r[2] for r in want}) < len(counts) and max(r[4] for r in want) > 5


def test_long_chains_have_one_root(spark):
    word = "aaaaaaaaaaaa"
    chain = [word[:k] + "b" * (len(word) - k) for k in range(len(word) + 1)]
    df = spark.createDataFrame([(w, 3 * 2 ** k) for k, w in enumerate(chain)], "word string, n bigint")
    got = {r.word: r for r in spelling.spelling_groups(df).collect()}
    assert {r.root for r in got.values()} == {word} and got[chain[0]].form == chain[1]


def test_pairs_of_letter_matrices():
    rng = random.Random(4)
    for size, longer in ((5, 5), (5, 6), (7, 7), (7, 8)):
        a = ["".join(rng.choice("abc") for _ in range(size)) for _ in range(80)]
        b = ["".join(rng.choice("abc") for _ in range(longer)) for _ in range(90)]
        i, j = spelling.near_pairs(spelling.letter_matrix(a, size), spelling.letter_matrix(b, longer), False)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {
            (x, y) for x in range(80) for y in range(90) if one_edit(a[x], b[y])}


def test_sharing_a_dimension_only_lessens_distances():
    codes = np.arange(0x20, 0x500)
    d = spelling.dimension(codes)
    assert d.min() >= 0 and d.max() < spelling.DIMENSIONS
    letters = np.array([ord(c) for c in "abcdefghijklmnopqrstuvwxyz"] + list(range(0xC0, 0x100)))
    assert len(set(spelling.dimension(letters).tolist())) == len(letters)


def test_odd_rows(odd):
    # the smallest counts come from long texts: lower limits make small words count too
    rows = [r[:2] for r in odd_docs()]
    counts = spelling.word_counts(odd, slip_every=7, table_words=50)
    got = Counter(map(tuple, spelling.spelling_groups(counts).collect()))
    assert got == plain_groups(plain_counts(rows, 7))


def test_long_texts_are_cut_outside_words(spark, monkeypatch):
    text = "Größe straße, Straße; straßen " * 30 + "ABCDEFGHIJ" * 40
    monkeypatch.setattr(spelling, "SECTION", 17)
    assert "".join(spelling._sections(text)) == text
    parts = list(spelling._sections(text.lower()))
    assert len(parts) > 20 and all(not (a[-1].isalpha() and b[0].isalpha()) for a, b in zip(parts, parts[1:], strict=False))


def test_the_given_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    got = Counter(map(tuple, op13_spelling_variants(spark, SMALL).collect()))
    want = plain_groups(plain_counts(rows))
    assert got == want and sum(1 for r in want if r[1]) > 5


def test_empty_tables_and_odd_names(spark, none):
    assert spelling.spelling_groups(spelling.word_counts(none)).count() == 0
    one = spark.createDataFrame([("x", "words Words WORDS wordz")], "`a.b` string, n string")
    got = spelling.spelling_groups(spelling.word_counts(one, "a.b", "n"), min_count=1).collect()
    assert {tuple(r) for r in got} == {("words", None, "words", 3, 1, None), ("wordz", "words", "words", 1, 1, 3)}
