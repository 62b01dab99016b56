"""Registered queries of the operators in this package, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dedup, html_text, mix, ngram_join, packing, periods, pieces, quality, secret_scan, spelling, substrings, tokens, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return put


@_query("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


@_query("op2_exact_dedup", dedup.ORACLE_SQL)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_decisions(table(spark, sf_dir, "documents"))


@_query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op4_ngram_jaccard", ngram_join.ORACLE_SQL)
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90).select(
        "doc_id", "n_shingles", "component_id")


@_query("op5_warc", warc.ORACLE_SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_and_read(table(spark, sf_dir, "pages"))
    response = F.col("record_type") == "response"
    return records.filter(F.col("record_type").isin("response", "revisit")).select(
        warc.page_id_of(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", warc.page_id_of(F.col("refers_to")).alias("refers_to"))


@_query("op6_html_text")
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@_query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.quality_verdicts(docs, model)


@_query("op8_substring_dedup", substrings.ORACLE_SQL)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces and score of the best segmentation, score of the second, a hash
    of the best one's ids, and whether decoding them gives the text back."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    best = coded.select(F.col("row.doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "scores",
                        F.col("segmentations")[0].alias("ids"))
    return pieces.decode_pieces(best, path).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.round(F.col("scores")[0], 4).alias("score"),
        F.round(F.get("scores", F.lit(1)), 4).alias("second_score"), F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == F.col("text")).alias("restored"))


@_query("op10_mix", mix.ORACLE_SQL)
def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_shares(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@_query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periods.with_planted_periods(table(spark, sf_dir, "documents"))
    return periods.run_digest(periods.periodic_runs(docs))


@_query("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spelling.word_counts(table(spark, sf_dir, "documents"), slip_every=97))
