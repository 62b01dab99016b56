"""The pipeline against plain Python, stage by stage, on the smallest tables."""

from collections import Counter

import duckdb
import public_tokenizers
from odd_rows import collapsed, mix_rows, near_groups, words
from test_llm_text import plain_counts

import corpus_pipeline
from ledgerlens.llm import pieces, quality

SMALL = "/root/testdata/sf0.001"


def expected(spark):
    docs = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SMALL}/documents.parquet'").fetchall()
    model = quality.train(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    good = []
    for d in docs:
        c = plain_counts(d[1])
        p = model.probability(quality.features(quality.text_counts([(d[1] or "").encode()])))[0] if model else 1
        if c[0] >= 50 and 100 * c[4] <= 50 * c[0] and p >= quality.THRESHOLD:
            good.append(d)
    least = {}
    for d in good:
        least[collapsed(d[1])] = min(least.get(collapsed(d[1]), d[0]), d[0])
    single = [d for d in good if least[collapsed(d[1])] == d[0]]
    groups = near_groups([d[:2] for d in single], 5, 80)
    alone = [d for d, g in zip(single, groups, strict=True) if d[0] == g]
    mixed = []
    for d, (_, size, _, _, taken) in zip(alone, mix_rows([(d[0], d[1], d[3]) for d in alone]), strict=True):
        whole, part = divmod(taken, size)
        mixed += [d] * whole
        if part:
            mixed.append((d[0], " ".join(words(d[1])[:part]), *d[2:]))
    return docs, good, single, alone, mixed


def test_stages_and_run(spark):
    docs, good, single, alone, mixed = expected(spark)
    assert len(docs) > len(good) > len(single) > len(alone) > 0
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    now = table
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], (good, single, alone, mixed), strict=True):
        now = stage(spark, now, SMALL)
        assert now.columns == table.columns
        assert Counter((r.doc_id, r.text) for r in now.collect()) == Counter(d[:2] for d in want)
        now = spark.createDataFrame(now.collect(), table.schema)
    encoder = pieces.Encoder(public_tokenizers.path(corpus_pipeline.PIECE_MODEL))
    want = Counter((d[0], tuple(encoder.encode(d[1])[0][1].tolist())) for d in mixed)
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert all(r.n_pieces == len(r.ids) and r.score >= r.second_score for r in got)
