"""Packing: against the tokenizer on whole texts and a round-by-round simulation."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from odd_rows import none, odd, odd_docs  # noqa: F401
from tokenizers import Tokenizer

from ledgerlens.llm import packing
from ledgerlens.llm.queries import op12_packing

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_whole(rows, want_ids, window):
    """Every id lies in one piece, sequences have no gap and only allowed sizes."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.start, r.length, list(np.frombuffer(bytes(r.ids), "<u4")), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    got = {i: [x for _, _, part, _ in sorted(parts, key=lambda p: p[0]) for x in part] for i, parts in docs.items()}
    assert got == want_ids
    for i, parts in docs.items():
        assert all(n == len(x) and total == len(want_ids[i]) for _, n, x, total in parts)
        assert sum(n for _, n, _, _ in parts) == len(want_ids[i])
    total = sum(map(len, want_ids.values()))
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        if s < total // window:
            assert at == window
        else:
            assert at & (at - 1) == 0
    assert len(sequences) <= total // window + window.bit_length()


def simulated(rows, window, grant, share):
    """Rounds of tokens by walking through the rounds; the queues' orders come from ``rows``."""
    queues = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        queues[r.source].append(r)
    left = {s: sum(r.length for r in q) for s, q in queues.items()}
    deficit, stream, round_ = dict.fromkeys(queues, 0.0), [], 0
    while any(left.values()):
        round_ += 1
        for s in sorted(queues, key=lambda s: "" if s is None else "=" + s):
            if not left[s]:
                continue
            quantum = window * share[s]
            deficit[s] += quantum
            if quantum >= grant:
                n = min(left[s], int(deficit[s] + 1e-6))
            else:
                n = min(left[s], int((deficit[s] + 1e-6) // grant) * grant)
                if deficit[s] + 1e-6 >= left[s]:
                    n = left[s]
            deficit[s] -= n
            left[s] -= n
            if n:
                stream.append((s, round_, n))
    return stream


def made_docs(seed=3, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["naïve", "日本語", "x" * 30]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    sources = ["hot"] * 10 + ["warm"] * 3 + ["tiny", None, "é"]
    return [(i, text(rng.choice([0, 1, 5, 40, 300])), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize(("window", "grant"), [(256, 32), (256, 1), (100, 40)])
def test_rounds_equal_the_simulation(spark, tokenizer, window, grant):
    docs = made_docs()
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(5)
    rows = packing.pack(df, PATH, window=window, grant=grant, item_tokens=200, rows_per_range=40, rounds_per_range=7).collect()
    want = {i: ids_of(tokenizer, t) for i, t, _ in docs}
    check_whole(rows, want, window)
    sizes = Counter()
    for i, _, s in docs:
        sizes[s] += len(want[i])
    total = sum(sizes.values())
    share = {s: n / total for s, n in sizes.items()}
    got = []
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        if got and got[-1][:2] == [r.source, r.round]:
            got[-1][2] += r.length
        else:
            got.append([r.source, r.round, r.length])
    assert [tuple(x) for x in got] == simulated(rows, window, grant, share)
    # every full sequence holds the target shares to within a grant (or what one round holds) for each source
    held = defaultdict(Counter)
    for r in rows:
        held[r.sequence_id][r.source] += r.length
    for s in range(total // window):
        for source, p in share.items():
            assert abs(held[s][source] - p * window) <= max(grant, p * window) * 2 + 2
    for source, p in share.items():     # and carried deficits keep any prefix there
        run = 0
        for s in range(total // window):
            run += held[s][source]
            assert abs(run - p * window * (s + 1)) <= 2 * max(grant, p * window) + 2


def test_weights(spark):
    docs = made_docs(5)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    weights = {"hot": 1.0, "warm": 1.0, "tiny": 1.0, None: 1.0, "é": 4.0}
    rows = packing.pack(df, PATH, window=256, grant=16, weights=weights).collect()
    first = Counter()
    for r in rows:
        if r.sequence_id < 4:
            first[r.source] += r.length
    assert abs(first["é"] - 512) < 40 and abs(first["hot"] - 128) < 40
    assert sum(r.length for r in rows) == sum({(r.doc_id): r.doc_tokens for r in rows}.values())
    with pytest.raises(Exception, match="no weight for source"):
        packing.pack(df, PATH, weights={"hot": 1.0}).collect()
    with pytest.raises(ValueError):
        packing.pack(df, PATH, weights={"hot": 0.0})


def test_ids_of_whole_texts(tokenizer):
    rng = random.Random(1)
    spaces = [" ", "  ", "\n", "\t ", "\x0b", "\u00a0", "\u3000 ", "\u2009", "   ", "\x1c", "\x85 ", " \u00a0 ", "\u202f "]
    texts = ["".join(rng.choice(["word", "Ünï", "日本", "'s", "12", "!?", "<|endoftext|>", "😀", *spaces])
                     for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["", " ", "\n\n", "a" * 3000, " " * 3000, "é" * 700 + " x", "ab" * 127 + " " + "c" * 256]
    for limit in (50, 1 << 20):
        encoder = packing.Encoder(PATH, batch_bytes=limit)
        for t in [*texts, "".join(texts)]:
            assert encoder.encode(t.encode()).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert len(encoder.encode(None)) == 0
    whole = "".join(texts).encode()
    assert b"".join(packing.sections(whole, 500)) == whole and len(list(packing.sections(whole, 500))) > 20


def test_the_fast_library_agrees_on_every_letter(tokenizer):
    encoder = packing.Encoder(PATH)
    assert encoder.fast is not None
    rng = random.Random(2)
    some = [chr(c) for c in [*range(0x3100), *range(0x3100, 0x20000, 13)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}{c} 1{c} '{c}  {c}\n" for c in some]
    texts += [form.format(c) for c in some[:0x250] for form in ("x {0}s  {0}", "!{0}?", "'{0}'ll{0}", "{0}{0} {0}\n")]
    texts += ["".join(rng.choices(some[:0x250], k=40)) for _ in range(1000)] + ["".join(rng.choices(some, k=40)) for _ in range(1000)]
    for t in texts:
        assert packing._short_runs(np.frombuffer(t.encode(), np.uint8))
        assert encoder.encode(t.encode()).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    assert not packing._short_runs(np.frombuffer(b"x" * 300, np.uint8))
    assert not packing._short_runs(np.frombuffer(b"x" + b" " * 300 + b"y", np.uint8))


def test_other_vocabularies_use_their_own_library():
    from tokenizers import Tokenizer as Any
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Any.from_file(path)
    encoder = packing.Encoder(path)
    assert encoder.fast is None and packing.id_width(encoder, 1) == "<u2" and packing.id_width(encoder, 1 << 16) == "<u4"
    assert encoder.encode(b"Some Words here").tolist() == own.encode("Some Words here", add_special_tokens=False).ids


def test_tail():
    assert packing.tail_cuts(0, 2048) == [] and packing.tail_cuts(4096, 2048) == []
    assert packing.tail_cuts(2048 + 1029, 2048) == [(1, 2048, 3072), (2, 3072, 3076), (3, 3076, 3077)]


def test_odd_rows(odd, tokenizer):
    rows = packing.pack(odd, PATH, item_tokens=1000).collect()
    docs = Counter()
    for i, t, *_ in odd_docs():
        docs[i, tuple(ids_of(tokenizer, t))] += 1
    tokens = sum(len(x) * n for (_, x), n in docs.items())
    assert sum(r.length for r in rows) == tokens
    once = {i: list(x) for (i, x), n in docs.items() if n == 1 and sum(k[0] == i for k in docs) == 1}
    assert len(once) > 20
    for i, x in once.items():
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [v for r in own for v in np.frombuffer(bytes(r.ids), "<u4").tolist()] == x


def test_the_given_table(spark, tokenizer):
    rows = op12_packing(spark, SMALL).collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
    want = {i: ids_of(tokenizer, t) for i, t in texts.items()}
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    at = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        part = np.array(want[r.doc_id][r.start:r.start + r.length], dtype="<u4")
        assert (r.start, r.doc_tokens, r.ids_crc32) == (at[r.doc_id], len(want[r.doc_id]), zlib.crc32(part.tobytes()))
        at[r.doc_id] += r.length
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for a, b in zip(places, places[1:], strict=False):
        assert b[:2] == ((a[0], a[1] + a[2]) if a[0] == b[0] else (a[0] + 1, 0))


def test_empty_table(none):
    out = packing.pack(none, PATH)
    assert out.count() == 0 and "sequence_id" in out.columns
