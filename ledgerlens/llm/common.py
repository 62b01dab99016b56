"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# white space that separates words everywhere in this package
WS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this library to the Python workers once for each application, as a zip through
    Spark's own file distribution, so that they need no copy of it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(package)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(package)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, package)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def release_memory() -> None:
    """Give what this worker process has freed back to the system.  Idle workers stay for the
    next stage, and the allocators keep freed pages, beside an executor that then fills its heap."""
    from . import words
    words.forget_powers()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable, schema: StructType | str, release: bool = False) -> DataFrame:
    """``mapInArrow`` with this library on the workers; with ``release`` a worker gives its
    memory back after each task."""
    ship_package(df.sparkSession)

    def released(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(parts)
        finally:
            release_memory()

    return df.mapInArrow(released if release else run, schema)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int, size: int = 4 << 20) -> Iterator[None]:
    """Jobs started inside hand at most ``rows`` rows and about ``size`` bytes at a time (one row
    if it is larger) to Python, in place of the session's numbers (10,000 and 64 MB): a batch of
    long rows is held several times, by Spark on both sides of the pipe and by the worker."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
              "spark.sql.execution.arrow.maxBytesPerBatch": f"{size}b"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def field(name: str) -> Column:
    """A column by its exact name (dots and back-ticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that helper columns beside it can have any name."""
    return F.struct(*[field(c) for c in df.columns])


def unpack(df: DataFrame, columns: Sequence[str], row: str = "row") -> DataFrame:
    return df.select(*[F.col(row).getField(c).alias(c) for c in columns])


def collapse_space(text: Column) -> Column:
    """Each white-space run as one space, null as ''.  The pattern skips runs that
    are one space already, so that ordinary prose has few replacements."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[\\x09-\\x0D][{WS}]*|\\x20[{WS}]+", " ")


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    t = F.trim(collapse_space(text))
    spaces = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(spaces + 1).cast("bigint")


# --- a bounded set of hashes as a bitmap -------------------------------------

FILTER_BITS = 1 << 26   # 2,048 rows of 4 KB: at most 8 MB however large the input


def _slot(key: Column, bits: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) + 1


def bitmap_of_slots(slots: DataFrame, slot: str = "slot") -> DataFrame:
    """(bucket, bits): one 4 KB bitmap for each 32,768 slots that occur."""
    return slots.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col(slot))).alias("bits"))


def bitmap_of(keys: DataFrame, key: Column, bits: int = FILTER_BITS, seed: int = 0) -> DataFrame:
    """A bitmap over the hashes of ``key``: at most ``bits / 8`` bytes, so it may be
    broadcast at any input size.  More keys only mean more false positives, which
    callers remove with an exact join."""
    return bitmap_of_slots(keys.select(_slot(key, bits, seed).alias("slot")))


def bit_is_set(bits: Column, slot: Column) -> Column:
    pos = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.expr("1").cast("int") * F.pow(F.lit(2), pos % 8).cast("int")) != 0,
                      F.lit(False))


def with_slot_flag(df: DataFrame, bitmap: DataFrame, slot: Column, flag: str) -> DataFrame:
    """``df`` with a boolean: is the slot's bit set?  The bitmap is bounded by its
    bit count, so it is broadcast and ``df`` does not move."""
    cols = df.columns
    left = df.withColumn("_slot", slot).withColumn("_bucket", F.bitmap_bucket_number("_slot"))
    right = F.broadcast(bitmap.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")))
    return left.join(right, "_bucket", "left").select(
        *[field(c) for c in cols], bit_is_set(F.col("_bits"), F.col("_slot")).alias(flag))


def with_member_flag(df: DataFrame, bitmap: DataFrame, key: Column, flag: str,
                     bits: int = FILTER_BITS, seed: int = 0) -> DataFrame:
    return with_slot_flag(df, bitmap, _slot(key, bits, seed), flag)


# --- joins on keys that may hold a third of all rows ----------------------------

HEAVY_PARTS = 1000


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (one row per key, ``size`` = its number of
    rows).  Keys with more than ``total / 1000`` rows number fewer than 1,000, so they
    are broadcast and their rows stay where they are; every other key holds at most a
    thousandth of the rows and is joined by a shuffle."""
    is_heavy = F.col(size) * HEAVY_PARTS > F.lit(total)
    heavy, light = keyed.filter(is_heavy), keyed.filter(~is_heavy)
    hot = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return hot.unionByName(rest)
