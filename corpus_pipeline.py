"""From raw documents to a mixed, encoded training corpus, in five stages.

Each stage takes (spark, docs, sf_dir), calls one operator of ``ledgerlens.llm`` on all rows
that the stage before kept, and returns a DataFrame; between stages the rows are written
as Parquet and read again, so a lost executor never costs more than one stage.

1. quality: rows that fail the fixed rules or the trees (trained on ``labels``) go.
2. exact dedup: of equal texts the row with the smallest doc_id stays.
3. near duplicates: five-word shingles, Jaccard similarity 0.8 or more; of each component
   the document with the smallest doc_id stays.
4. mixing: sources at weights 1, 2, 3, repeating; documents come once for each epoch, and
   the one at a source's cut is shortened to its budget.
5. encoding: the piece ids of the best segmentation and the scores of the two best.

Stages 1 to 4 return the columns of ``documents``.  No SQL states the whole: the trees of
stage 1 and the pieces of stage 5 are beyond it; the tests hold ``run`` against plain Python.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import dedup, mix, ngram_join, pieces, quality
from ledgerlens.session import cut_lineage

PIECE_MODEL = "piece_bpe_32k.model"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, words=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mix(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, lang, source, n_pieces, score, second_score, ids."""
    coded = pieces.encode_pieces(docs.select("doc_id", "lang", "source", "text"),
                                 public_tokenizers.path(PIECE_MODEL))
    ids = F.col("segmentations")[0]
    return coded.select("row.doc_id", "row.lang", "row.source", F.size(ids).cast("bigint").alias("n_pieces"),
                        F.round(F.col("scores")[0], 4).alias("score"),
                        F.round(F.get("scores", F.lit(1)), 4).alias("second_score"), ids.alias("ids"))


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing to target weights", mix_stage),
    ("SentencePiece encoding", encode_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
