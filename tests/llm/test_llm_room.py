"""What the near-duplicate stage holds: bytes of a batch handed to Python, tables left on disk."""

import os

import pyarrow as pa
from odd_rows import near_groups
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens.llm import common, ngram_join


def test_batches_are_bounded_in_bytes(spark):
    """100 rows of 200 kB and one of 3 MB: batches of about 1 MB, or of the one row."""
    long = F.expr("CAST(repeat('x', IF(id = 50, 3000000, 200000)) AS BINARY)")
    rows = spark.range(0, 100, 1, 1).select(long.alias("b"))

    def sizes(parts):
        for part in parts:
            yield pa.record_batch([pa.array([part.num_rows], pa.int64()), pa.array([part.nbytes], pa.int64())], names=["n", "size"])

    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n) for n in names]
    with common.small_batches(spark, 500, 1 << 20):
        got = common.map_arrow(rows, sizes, "n bigint, size bigint").collect()
    assert sum(r.n for r in got) == 100
    assert all(r.size <= 1_500_000 for r in got if r.size < 3_000_000)
    assert max(r.size for r in got) < 3_000_000 + 1_500_000
    assert [spark.conf.get(n) for n in names] == before


def test_join_leaves_only_the_tables_it_needs(spark):
    """Families of near copies in chains, so that both rounds and the token lists are written."""
    rows = []
    for family in range(12):
        base = [f"f{family}w{k}" for k in range(120)]
        for edit in range(10):
            base[7 * edit] = f"e{edit}"
            rows.append((len(rows), " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    root = session.checkpoint_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    kept = ngram_join.keep_one(docs, words=3, percent=80)
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(root)) - before}
    assert left == {"join-dropped", "join-drop-bits"}
    want = [i for (i, _), g in zip(rows, near_groups(rows, 3, 80), strict=True) if i == g]
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert len(want) < len(rows)
