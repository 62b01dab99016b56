"""Scans and sinks: CSV with header, Parquet.

The CSV scan reads columns by the names in the header, in whatever order the
file has them, and always with an explicit schema (no inference pass over the
data): all strings, or typed with PERMISSIVE mode and a corrupt-record column, or
split into typed rows and a quarantine table that says what is wrong with each line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..session import cut_lineage

CORRUPT = "_corrupt_record"


def _with_key(schema: T.StructType, key: str | None, key_type=T.LongType()) -> T.StructType:
    if not key:
        return schema
    return T.StructType([T.StructField(key, key_type, True)] + list(schema.fields))


def _wanted_and_file_schema(spark: SparkSession, path: str, typed: bool, key: str | None):
    """(wanted schema, schema in the header's order); a missing column raises."""
    wanted = _with_key(S.TXN_SCHEMA, key) if typed else _with_key(S.TXN_STRING_SCHEMA, key, T.StringType())
    header = spark.read.option("header", True).csv(path).columns    # reads one line
    missing = [f.name for f in wanted.fields if f.name not in header]
    if missing:
        raise ValueError(f"columns not in the header of {path}: {missing}")
    return wanted, T.StructType([wanted[c] if c in wanted.names else T.StructField(c, T.StringType()) for c in header])


def read_transactions_csv(spark: SparkSession, path: str, typed: bool = False,
                          key: str | None = None) -> DataFrame:
    """Transactions CSV with header; ``typed=False`` gives 11 string columns.  Columns are
    found by header name; a missing one raises, others are ignored."""
    wanted, schema = _wanted_and_file_schema(spark, path, typed, key)
    if not typed:
        return spark.read.schema(schema).option("header", True).csv(path).select(*wanted.names)
    return _permissive(spark, path, schema).select(*wanted.names, CORRUPT)


def _permissive(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    return (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).csv(path))


def read_transactions_csv_checked(spark: SparkSession, path: str, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine).  ``rows``: the typed columns of all lines that have exactly the
    header's fields, each empty or of its column's type.  ``quarantine``: every other line as
    (file, line, n_fields, failed_column, reason), whole and unchanged; failed_column is
    the first in file order whose text is no value of its type, null where the number of
    fields is wrong.  Blank lines are neither.

    The files are parsed once, all columns at a time (a pruned scan would not see a bad
    value in a column it skips), and the parsed rows are written as Parquet."""
    wanted, schema = _wanted_and_file_schema(spark, path, True, key)
    parsed = _permissive(spark, path, schema).withColumn("_file", F.col("_metadata.file_path"))
    parsed = cut_lineage(parsed, "csv-parsed")
    rows = parsed.filter(F.col(CORRUPT).isNull()).select(*wanted.names)
    bad = parsed.filter(F.col(CORRUPT).isNotNull()).select(F.col("_file").alias("file"), F.col(CORRUPT).alias("line"))
    return rows, _diagnosed(bad, schema)


def _diagnosed(bad: DataFrame, schema: T.StructType) -> DataFrame:
    n = len(schema.fields)
    # quoted parts may hold separators; a backslash escapes inside them
    outside = F.regexp_replace("line", r'"(\\.|[^"\\])*"', "")
    fields = F.length(outside) - F.length(F.replace(outside, F.lit(","), F.lit(""))) + 1
    texts = ", ".join(f"c{i} STRING" for i in range(n))
    d = bad.withColumn("n_fields", fields).withColumn("_t", F.from_csv("line", texts))

    def fails(i: int, f: T.StructField) -> Column:
        text = F.col(f"_t.c{i}")
        # the scan takes no blanks around a number; a cast would
        return text.isNotNull() & ((F.trim(text) != text) | text.try_cast(f.dataType).isNull())

    typed = [(i, f) for i, f in enumerate(schema.fields) if not isinstance(f.dataType, T.StringType)]
    column = F.coalesce(*[F.when(fails(i, f), F.lit(f.name)) for i, f in typed]) if typed else F.lit(None).cast("string")
    kind = F.coalesce(*[F.when(fails(i, f), F.lit(f"not a value of type {f.dataType.simpleString()}")) for i, f in typed]) \
        if typed else F.lit(None).cast("string")
    same = F.col("n_fields") == n
    return d.select("file", "line", "n_fields", F.when(same, column).alias("failed_column"),
                    F.when(F.col("n_fields") < n, "too few fields").when(F.col("n_fields") > n, "too many fields")
                    .otherwise(F.coalesce(kind, F.lit("not readable"))).alias("reason"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def convert_to_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Rewrite a scan as Parquet; the default mode refuses an existing target."""
    df.write.mode(mode).parquet(path)
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_prepared(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> str:
    """The prepared, balanced table for the tuning jobs (many files, not one).

    ``partition_by`` (fold, split) lays it out in one folder for each value, so that a job
    that filters on these columns lists and reads its folders only.  With mode
    ``overwrite`` only the folders that ``df`` has rows for are replaced."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)
    return path
