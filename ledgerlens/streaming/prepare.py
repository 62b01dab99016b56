"""Stateless preparation and scoring on a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import clean, features


def read_transactions_stream(spark: SparkSession, path: str, fmt: str = "parquet", key: str | None = S.KEY,
                             max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of typed transaction files (explicit schema: no inference)."""
    fields = list(S.TXN_SCHEMA.fields)
    from pyspark.sql import types as T
    schema = T.StructType(([T.StructField(key, T.LongType(), True)] if key else []) + fields)
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def prepare_stream(df: DataFrame, key: str | None = S.KEY) -> DataFrame:
    """The row-local part of ``flow.prepare`` with fixed category labels."""
    t = features.pair_code(df)
    t = features.get_dummies(t, ["type", "type2"], categories={"type": S.TYPE_LABELS, "type2": S.TYPE2_LABELS})
    t = features.drop_columns(t, S.ID_COLUMNS + S.BALANCE_COLUMNS)
    t = t.select(*(([key] if key else []) + S.FEATURES + [S.LABEL]))
    return clean.drop_nulls(t)


def score_stream(model, df: DataFrame, keep=(S.KEY,), label: str = S.LABEL) -> DataFrame:
    """Apply a fitted pipeline model to a stream (ML transformers are stateless)."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df.withColumn(label, F.col(label).cast("double")))
    return out.select(*keep, F.col(label).alias("label"), "prediction",
                      vector_to_array("probability")[1].alias("score"))
