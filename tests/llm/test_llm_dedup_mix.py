from collections import Counter, defaultdict

from odd_rows import SCHEMA, collapsed, mix_rows, none, odd, odd_docs, sha, words  # noqa: F401

from ledgerlens.llm import dedup, mix


def _groups(rows):
    out = defaultdict(list)
    for i, t in rows:
        out[collapsed(t)].append(i)
    return out


def test_decisions_match_plain_grouping(odd):
    rows = [r[:2] for r in odd_docs()]
    got = dedup.dedup_decisions(odd, filter_bits=1 << 17).collect()
    groups = _groups(rows)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, least[collapsed(t)], len(groups[collapsed(t)]), sha(collapsed(t))) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter({sha(t): 1 for t in groups})       # exactly one row of each group
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_a_tiny_filter_stays_exact(odd):
    want = Counter(dedup.dedup_decisions(odd).collect())
    assert Counter(dedup.dedup_decisions(odd, filter_bits=1 << 6).collect()) == want


def test_rows_that_stay_keep_their_columns(odd):
    kept = dedup.exact_dedup(odd)
    assert kept.schema == odd.schema
    got = [tuple(r) for r in kept.collect()]
    groups = _groups([r[:2] for r in odd_docs()])
    assert Counter(collapsed(r[1]) for r in got) == Counter(dict.fromkeys(groups, 1))
    assert all(r[0] == min((i for i in groups[collapsed(r[1])] if i is not None), default=None) for r in got)
    assert set(got) <= {tuple(r) for r in odd.collect()}


def test_a_group_with_a_third_of_all_rows(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(6000)]
    got = dedup.dedup_decisions(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8))
    assert got.filter("kept").count() == 4001
    assert got.filter("group_size = 2000 AND keep_id = 0").count() == 2000


def test_empty_tables(none):
    assert dedup.dedup_decisions(none).count() == 0
    assert dedup.exact_dedup(none).count() == 0
    assert mix.mix_shares(none).count() == 0
    assert mix.mix(none).count() == 0


def _rounded(rows):
    return Counter((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in rows)


def test_shares_match_plain_python(odd):
    rows = [(r[0], r[1], r[2]) for r in odd_docs()]
    got = mix.mix_shares(odd).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert _rounded(got) == _rounded(mix_rows(rows))


def test_shares_with_many_ranges_and_a_hot_source(spark):
    rows = [(i, "w " * (i * 7 % 40), "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(8)
    got = mix.mix_shares(df, rows_per_range=100).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert _rounded(got) == _rounded(mix_rows(rows))
    taken, target = Counter(), {}
    for (_, _, s), r in zip(sorted(rows), sorted(got), strict=True):
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size
    assert all(target[s] - 1 <= taken[s] <= target[s] for s in target)


def test_mixed_rows_hold_what_is_taken(odd):
    rows = odd_docs()
    want = mix_rows([(r[0], r[1], r[2]) for r in rows])
    mixed = mix.mix(odd, length_col="n_chars")
    assert mixed.schema == odd.schema
    got = mixed.collect()
    total = Counter()
    for r, w in zip(rows, want, strict=True):
        total[r[0]] += w[4]
    taken = Counter()
    for r in got:
        taken[r.doc_id] += len(words(r.text))
    assert +taken == +total
    whole = {(r[0], r[1]) for r in rows}
    for r in got:
        if (r.doc_id, r.text) not in whole:      # shortened: a prefix, with its new length
            assert r.n_chars == len(r.text)
            assert any(i == r.doc_id and words(t)[:len(words(r.text))] == words(r.text) for i, t in whole)


def test_reruns_agree(spark, odd):
    again = spark.createDataFrame(odd_docs(), SCHEMA).repartition(7)
    assert Counter(mix.mix_shares(odd).collect()) == Counter(mix.mix_shares(again).collect())
