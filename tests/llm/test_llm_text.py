"""Secret scan, token counts, quality statistics, pieces: against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from odd_rows import none, odd, odd_docs, words  # noqa: F401

from ledgerlens.llm import pieces, quality, secret_scan, tokens

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_of_odd_rows(odd):
    got = secret_scan.scan_secrets(odd).collect()
    want = Counter()
    for r in odd_docs():
        spans = base_spans(r[1] or "")
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        counts = Counter(k for _, k, _ in spans)
        want[r[0], counts[0], counts[1], counts[2], hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert all(set(s for s in r.spans.split(",") if not s.startswith("entropy")) >= set() for r in got)


def test_base_spans_of_random_texts():
    rng = random.Random(2)
    bits = ["password", "Token", "api_key", "API KEY", "=", ":", " ", '"', "AKIA", "ABCDEF0123456789XY", "deadbeef",
            "0123456789abcdef", "secret", "abc", "-", ".", "é", "\n", "ſecret=abcdefgh"]
    scan = secret_scan.Scanner(secret_scan.Scan())
    for _ in range(500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert scan(text)[0] == base_spans(text)


def test_window_entropy_is_the_plain_one():
    rng = random.Random(3)
    for _ in range(200):
        s = "".join(rng.choice("abcdef0123456789"[:rng.randint(2, 16)]) for _ in range(rng.randint(0, 60)))
        w, bits = rng.choice([8, 20]), rng.choice([2.0, 2.7, 3.0])
        hot = set()
        for i in range(len(s) - w + 1):
            counts = Counter(s[i:i + w]).values()
            if -sum(c / w * math.log2(c / w) for c in counts) >= bits - 1e-9:
                hot.update(range(i, i + w))
        got = secret_scan.window_spans(s, w, bits)
        assert {k for a, b in got for k in range(a, b)} == hot
        assert all(x[1] < y[0] for x, y in zip(got, got[1:], strict=False))


def test_entropy_finds_keys_and_leaves_prose():
    scan = secret_scan.Scanner(secret_scan.Scan())
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ9tL2aBcD"
    assert [m for m in scan(f"key is {key} ok")[1]] == [(7, 3, 7 + len(key))]
    assert scan("F00D" * 2 + "9A3B7C1D5E8F2A4B6C0D")[1]                     # upper-case hex
    for clean in ("internationalization-and-localization/of/words", "123e4567-e89b-12d3-a456-426614174000",
                  "Donaudampfschifffahrtsgesellschaft", "example-key-1234abcd5678efgh", "2024-01-01/2024-12-31-0000",
                  "path/to/some/long/directory/name-2024", "aaaaaaaaaaaaaaaaaaaaaaaa1111"):
        assert not scan(clean)[1], clean
    base, more = scan(f"password={key}")
    assert base and not more                                                  # not reported twice


def test_placeholders_hide_only_their_piece():
    scan = secret_scan.Scanner(secret_scan.Scan())
    key = "Zq7Lw2Xv9Kc4Rb8Tn3Yd6Mf1Hg5Js0PuEaWiOxQz"
    for before, after in (("sample-app/", ""), ("sample_id=", ""), ("", "/example"), ("example/", "=dummy"),
                          ("v1/1234567/", "/0000000/x"), ("xxxx=sample=", "=/sample/your-name/")):
        text = f"the {before}{key}{after} ok"
        at = text.index(key)
        assert scan(text)[1] == [(at, 3, at + len(key))], text
    for clean in (f"sample-{key}", f"app/{key}0000000", "sample/123e4567-e89b-12d3-a456-426614174000",
                  "sample/path/to/some/long/directory/name-2024", "0000000/" * 40, "a1" + "1234567" * 40):
        assert not scan(clean)[1], clean
    two = f"{key}/sample/{key[::-1]}"
    assert scan(two)[1] == [(0, 3, len(key)), (len(two) - len(key), 3, len(two))]


def test_found_texts(spark):
    df = spark.createDataFrame([(1, "x token=abcdef9"), (2, None)], "doc_id bigint, text string")
    assert [tuple(r) for r in secret_scan.found_texts(df).collect()] == [(1, "assign", 2, 15, "token=abcdef9")]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_of_odd_rows(odd, tokenizer):
    got = tokens.count_tokens(odd, public_tokenizers.path("byte_bpe_50k.json"), batch_bytes=5000, table_size=300).collect()
    want = Counter()
    for r in odd_docs():
        n = len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)
        want[r[0], len((r[1] or "").encode()), n, n > 1024] += 1
    assert Counter(map(tuple, got)) == want


def test_safe_boundaries_add_up(tokenizer):
    rng = random.Random(4)
    alphabet = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "a", "B", "1", "!", "'s", "é", "語", "<|endoftext|>", "\r\n"]
    counter = tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert counter.count([text]) == [len(tokenizer.encode(text, add_special_tokens=False).ids)], repr(text)
        assert "".join(tokens.sections(text, 5)) == text


def plain_counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] >= 2 for k in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_counts_of_odd_rows(odd):
    got = quality.quality_verdicts(odd, None).collect()
    want = Counter()
    for r in odd_docs():
        c = plain_counts(r[1])
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want[(r[0], *c, failed, not failed)] += 1
    assert Counter(tuple(r)[:8] for r in got) == want


def test_quality_counts_of_a_text_in_pieces():
    text = ("the same words again\n" * 3 + "other ones é here\n") * 80_000       # beyond two batches
    assert tuple(quality.text_counts([text.encode()])[0][:5]) == plain_counts(text)


def test_kept_rows_are_whole(odd):
    kept = quality.keep_good(odd, None)
    assert kept.schema == odd.schema
    want = Counter(r for r in odd_docs() if not (plain_counts(r[1])[0] < 50 or 2 * plain_counts(r[1])[4] > plain_counts(r[1])[0]))
    assert Counter(map(tuple, kept.collect())) == want


def walk(forest, x):
    total = forest.bias
    for root in forest.root:
        node = root
        while forest.left[node] != node:
            node = forest.left[node] if x[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        total += forest.value[node]
    return total


def test_trees_learn_walk_and_stay_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = (x[:, 0] - x[:, 1] + 0.3 * np.sin(9 * x[:, 2]) + 0.2 * rng.standard_normal(3000) > 0).astype(float)
    forest = quality.fit_forest(x[:2000], y[:2000], [1, -1, 0, 0])
    assert ((forest.probability(x[2000:]) > 0.5) == (y[2000:] > 0)).mean() > 0.85      # held out
    assert np.allclose(forest.margin(x[:50]), [walk(forest, r) for r in x[:50]])
    for j, sign in ((0, 1), (1, -1)):
        grid = np.repeat(x[:40, None, :], 60, axis=1)
        grid[:, :, j] = np.linspace(0, 1, 60)
        steps = np.diff(forest.margin(grid.reshape(-1, 4)).reshape(40, 60), axis=1) * sign
        assert (steps >= -1e-12).all()


def test_training_reads_labels(spark):
    docs = [(i, " ".join(f"w{(i * k) % 97}" for k in range(60)) + (" ###" * 30 if i % 2 else "")) for i in range(400)]
    docs += [(5, None), (None, "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(300)] + [(9999, 1), (1, None), (None, 1)],
                                   "doc_id bigint, quality int")
    model = quality.train(df, labels)
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(df.filter("doc_id >= 300"), model).collect()}
    assert all(got[i] == (i % 2 == 0) for i in range(300, 388))
    assert quality.train(df, labels.filter("quality = 1")) is None
    assert quality.train(df.limit(0), labels) is None


def test_training_takes_one_row_of_each_id(spark, monkeypatch):
    docs = [(i, " ".join(["word"] * (i + 3))) for i in range(6)] + [(2, "a much longer text of the same id " * k) for k in range(1, 40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_forest", lambda x, y, *_: seen.append((x, y)))
    quality.train(df, labels)
    quality.train(df, labels, sample_rows=4)
    (x, y), (few, _) = seen
    counts = [min(tuple(quality.text_counts([t.encode()])[0]) for k, t in docs if k == i) for i in range(6)]
    assert len(few) == 4 and y.tolist() == [0, 1] * 3
    assert np.array_equal(x, quality.features(np.array(counts)))


def test_labels_that_differ_do_not_depend_on_the_order(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} " * (i + 1)) for i in range(6)], "doc_id bigint, text string")
    labels = [(i, y) for i in range(6) for y in ((i % 2,) if i < 4 else (0, 1))] + [(None, 1), (3, None)]
    seen = []
    monkeypatch.setattr(quality, "fit_forest", lambda x, y, *_: seen.append(sorted(zip(x.tolist(), y.tolist(), strict=True))))
    for order in (labels, labels[::-1], labels[3:] + labels[:3]):
        quality.train(docs, spark.createDataFrame(order, "doc_id bigint, quality int").repartition(3))
    assert seen[0] == seen[1] == seen[2] and sum(y for _, y in seen[0]) == 2 and len(seen[0]) == 6


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def all_paths(lattice, s):
    out = []

    def go(i, score, ids):
        if i == len(s):
            out.append((score, ids))
        for j in range(i + 1, min(len(s), i + lattice.longest) + 1):
            p = s[i:j]
            if p in lattice.pieces:
                go(j, score + lattice.pieces[p], ids + lattice.ids[p])
            elif j == i + 1:
                go(j, score + lattice.unknown, ids + b"".join(lattice.bytes[b] for b in p.encode()))
    go(0, 0.0, b"")
    return sorted(out, key=lambda x: -x[0])


def test_n_best_is_the_best_of_all_segmentations():
    encoder, decoder = pieces.Encoder(MODEL, n_best=4), pieces.Decoder(MODEL)
    rng = random.Random(3)
    texts = ["the thing", "a\n\nb", "  x  ▁y", "ça va? \U0001F600", "aaaaaaa", "\t", " "]
    texts += ["".join(rng.choice("thean in\n▁ç,") for _ in range(rng.randint(1, 10))) for _ in range(60)]
    for t in texts:
        want, got = all_paths(encoder.lattice, " " + t), encoder.encode(t)
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in want[:4]], t
        assert {ids.tobytes() for _, ids in got} <= {ids for _, ids in want}
        assert len({ids.tobytes() for _, ids in got}) == len(got)
        assert all(decoder.decode(ids) == t for _, ids in got)


def test_pieces_restore_odd_rows(odd):
    coded = pieces.encode_pieces(odd, MODEL, table_bytes=20_000)
    assert [f.name for f in coded.schema["row"].dataType.fields] == [c for c in odd.columns if c != "text"]
    from pyspark.sql import functions as F
    back = pieces.decode_pieces(coded.withColumn("ids", F.col("segmentations")[0]), MODEL).collect()
    assert Counter(r.decoded for r in back) == Counter(r[1] or "" for r in odd_docs())
    assert all(r.decoded == (r.text or "") for r in back)
    assert all(r.scores == sorted(r.scores, reverse=True) for r in back)
    encoder = pieces.Encoder(MODEL)
    assert {tuple(r.ids) for r in back} == {tuple(encoder.encode(r[1] or "")[0][1].tolist()) for r in odd_docs()}


def test_decoding_replaces_a_column_of_its_name(odd):
    from pyspark.sql import functions as F
    coded = pieces.encode_pieces(odd.limit(8), MODEL).select("text", F.col("segmentations")[0].alias("ids"), F.lit("old").alias("decoded"))
    back = pieces.decode_pieces(coded, MODEL)
    assert back.columns == ["text", "ids", "decoded"] and all(r.decoded == (r.text or "") for r in back.collect())
    own = pieces.decode_pieces(coded.drop("decoded"), MODEL, "ids", "ids")
    assert own.columns == ["text", "ids"] and all(r.ids == (r.text or "") for r in own.collect())


def test_the_table_of_chunks_is_bounded_by_bytes():
    encoder = pieces.Encoder(MODEL, table_bytes=30_000)
    text = " ".join(f"word{i}" for i in range(2000))
    whole = pieces.Encoder(MODEL).encode(text)
    for part in (text[:5000], text, "short", text[9000:]):
        encoder.encode(part)
    encoder.encode("after")
    assert encoder.table.held < 30_000 and len(encoder.table) < 60
    assert [(s, ids.tolist()) for s, ids in encoder.encode(text)] == [(s, ids.tolist()) for s, ids in whole]


def test_empty_tables(none):
    assert secret_scan.scan_secrets(none).count() == 0
    assert tokens.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert quality.quality_verdicts(none, None).count() == 0
    assert pieces.encode_pieces(none, MODEL).count() == 0
