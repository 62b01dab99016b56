"""N-gram join and substring dedup: against plain Python over all pairs and windows."""

import random
from collections import Counter

import numpy as np
import pytest
from odd_rows import components as plain_components
from odd_rows import near_groups, none, odd, odd_docs, shingles, substring_rows  # noqa: F401

from ledgerlens.llm import graph, ngram_join, substrings


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_groups_of_odd_rows(odd, n, percent):
    rows = [r[:2] for r in odd_docs()]
    got = ngram_join.near_duplicates(odd, words=n, percent=percent).collect()
    want = Counter((i, len(shingles(t, n)), g) for (i, t), g in zip(rows, near_groups(rows, n, percent), strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def edited(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        k = rng.randrange(len(w))
        what = rng.randrange(3)
        if what == 0:
            w[k] = f"n{rng.randrange(10**6)}"
        elif what == 1:
            w.insert(k, f"i{rng.randrange(10**6)}")
        else:
            del w[k]
    return w


@pytest.mark.parametrize("percent", [90, 80])
def test_families_near_the_threshold(spark, percent):
    """Families of edited copies whose similarities lie on both sides of the threshold, in
    blocks smaller than the families, and short texts."""
    rng = random.Random(percent)
    rows = []
    for family in range(8):
        base = [f"f{family}w{rng.randrange(60)}" for _ in range(rng.choice([12, 30, 90, 200]))]
        for _ in range(25):
            rows.append(" ".join(edited(rng, base, rng.randrange(5))))
    rows += [" ".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in range(60)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df, words=3, percent=percent, block=8).collect()}
    want = near_groups(rows, 3, percent)
    assert got == dict(enumerate(want))
    assert len(set(want)) > 20


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(7)
    for percent in (90, 80, 60):
        for _ in range(300):
            size = int(rng.choice([1, 2, 4, 5, 9, 10, 12, 19, 28, 60, 200, 700]))
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, max(1, size * (100 - percent) // 100) + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop // 2, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                assert np.intersect1d(ngram_join.set_keys(a, percent), ngram_join.set_keys(b, percent)).size


def test_traversal_loses_no_pair():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(rng.choice(base, int(rng.integers(200, 300)), replace=False)) for _ in range(70)]
    sets.sort(key=len)
    bits = np.array([np.frombuffer(ngram_join.token_bitmap(s).tobytes(), dtype=np.uint64) for s in sets])
    size = np.array([len(s) for s in sets])
    tree = ngram_join.build_tree(bits, size, np.arange(70))
    i, j, most = ngram_join.dual_traversal(tree, tree, 75)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    bound = dict(zip(zip(i.tolist(), j.tolist(), strict=True), most.tolist(), strict=True))
    linked = 0
    for x in range(70):
        for y in range(x + 1, 70):
            both = len(np.intersect1d(sets[x], sets[y]))
            if 100 * both >= 75 * (size[x] + size[y] - both):
                linked += 1
                assert (x, y) in found and bound[x, y] >= both
    assert 0 < linked and len(found) < 70 * 69 // 2       # and prunes some


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1200)]
    links += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5)]
    rng.shuffle(links)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == plain_components(nodes, [x for x in links if x[0] != x[1]])


def test_near_duplicates_go_and_columns_stay(odd):
    kept = ngram_join.keep_one(odd, words=3, percent=90)
    assert kept.schema == odd.schema
    rows = odd_docs()
    want = [r for r, g in zip(rows, near_groups([x[:2] for x in rows], 3, 90), strict=True) if r[0] is None or r[0] == g]
    assert Counter(map(tuple, kept.collect())) == Counter(want)


def test_windows_of_odd_rows(odd):
    got = substrings.substring_dedup(odd).collect()
    want = Counter(substring_rows([r[:2] for r in odd_docs()]))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want
    for r in got:
        assert sum(b - a for a, b in r.passages) == r.n_removed


def test_shared_passages_of_many_documents(spark):
    """A passage in a third of all rows, groups split at every prefix length."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(600):
        w = [rng.choice("abcdefgh") for _ in range(rng.randrange(50))]
        if i % 3 == 0:
            k = rng.randrange(len(w) + 1)
            w[k:k] = passage[rng.randrange(20):rng.randrange(35, 60)]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    want = Counter(substring_rows(rows))
    for group_rows in (20, 1000):
        got = substrings.substring_dedup(df, group_rows=group_rows).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want


def test_a_full_bitmap_stays_exact(odd):
    want = Counter(map(str, substrings.substring_dedup(odd).collect()))
    assert Counter(map(str, substrings.substring_dedup(odd, anchor_bits=1 << 15).collect())) == want


def test_empty_tables(none):
    assert ngram_join.near_duplicates(none).count() == 0
    assert ngram_join.keep_one(none).count() == 0
    assert substrings.substring_dedup(none).count() == 0


def test_wide_bitmaps_bound_the_overlap_and_exclude_most():
    rng = np.random.default_rng(9)
    excluded = 0
    for size in (1, 5, 100, 300, 5000, 20000):
        for other in {max(1, size * 8 // 10), size, size * 6 // 5}:
            pool = rng.integers(0, 1 << 63, 2 * size + other, dtype=np.uint64)
            for same in (0, size // 2, min(size, other)):
                a, b = np.unique(pool[:size]), np.unique(np.concatenate([pool[:same], pool[size:size + other - same]]))
                bound = ngram_join.wide_overlap(ngram_join.wide_bitmap(a).tobytes(), ngram_join.wide_bitmap(b).tobytes(), len(a), len(b))
                overlap = len(np.intersect1d(a, b))
                assert overlap <= bound <= min(len(a), len(b))
                excluded += bound * 180 < 80 * (len(a) + len(b)) and size > 5
    assert excluded >= 20
    assert len(ngram_join.wide_bitmap(np.arange(20000, dtype=np.uint64))) <= 2 * 20000


def test_sketches_bound_the_overlap_of_long_sets():
    rng = np.random.default_rng(10)
    sets = []
    for size in (900, 1030, 2000, 4500, 9000, 30000, 90000):
        pool = rng.integers(0, 1 << 63, 3 * size, dtype=np.uint64)
        sets += [np.unique(pool[:size]), np.unique(np.concatenate([pool[:size * 6 // 10], pool[size:size * 15 // 10]])),
                 np.unique(np.concatenate([pool[:size * 19 // 20], pool[2 * size:2 * size + 40]]))]
    made = [ngram_join.parity_sketch(s) for s in sets]
    sketches = [np.zeros(0, dtype=np.uint64) if x is None else np.frombuffer(x.tobytes(), dtype=np.uint64) for x in made]
    assert [x is None for x in made[:3]] == [True] * 3 and max(x.nbytes for x in sketches) == ngram_join.SKETCH_BITS // 8
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets)), indexing="ij"))
    for other in (sketches, list(sketches)):
        differ = ngram_join.least_differ(sketches, other, i, j)
        for x, y, d in zip(i.tolist(), j.tolist(), differ.tolist(), strict=True):
            assert d <= len(np.setxor1d(sets[x], sets[y]))
    bits = np.array([np.frombuffer(ngram_join.token_bitmap(s).tobytes(), dtype=np.uint64) for s in sets])
    size = np.array([len(s) for s in sets])

    def pairs(sketch):
        i, j, _ = ngram_join.dual_traversal(*[ngram_join.build_tree(bits, size, np.arange(len(sets)), sketch)] * 2, 80)
        return set(zip(i.tolist(), j.tolist(), strict=True))

    linked = {(x, y) for x in range(len(sets)) for y in range(x + 1, len(sets))
              if 180 * len(np.intersect1d(sets[x], sets[y])) >= 80 * (size[x] + size[y])}
    assert linked and linked <= pairs(sketches) <= pairs(None)
    assert {(9, 10), (10, 11)} <= pairs(None) - pairs(sketches)        # 4,500 tokens, 60 % in common


def test_long_documents_with_common_parts_do_not_pair(spark, monkeypatch):
    """30 documents of 5,000 words that share half of their shingles, and copies of three of them
    with a few edits: only those reach the comparison of full sets."""
    rng = random.Random(11)
    base = [f"b{rng.randrange(10**6)}" for _ in range(5000)]
    rows = [(k, " ".join(edited(rng, base, 350))) for k in range(30)]
    rows += [(30 + k, " ".join(edited(rng, rows[k][1].split(), 20))) for k in range(3)]
    seen = {}
    written = ngram_join.cut_lineage

    def counted(df, name="stage"):
        out = written(df, name)
        if name in ("join-pairs", "join-more-pairs"):
            seen[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "cut_lineage", counted)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df, words=5, percent=80, block=16).collect()}
    assert got == dict(enumerate(near_groups(rows, 5, 80)))
    assert sorted(k for k, v in got.items() if k != v) == [30, 31, 32]
    assert sum(seen.values()) <= 20, seen       # with a pair for each block of a key
