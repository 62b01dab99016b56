"""Schemas of the transaction table and the fixtures built from the test tables.

``txn(spark, sf_dir)`` turns ``events`` into the eleven-column transaction
table (plus ``event_id`` as key), following FIXTURES.md §2.  The same
definitions exist as SQL text for DuckDB (``TXN_SQL``...), so the oracle
queries can start from identical inputs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The raw transaction columns, and the two categorical columns' labels.
RAW_COLUMNS = ["step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig",
               "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud"]
TYPE_LABELS = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]
TYPE2_LABELS = ["CC", "CM"]
BALANCE_COLUMNS = ["oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
                   "isFlaggedFraud"]
ID_COLUMNS = ["nameOrig", "nameDest"]
LABEL = "isFraud"
KEY = "event_id"

# Prepared feature columns in the order the reference assembles them.
FEATURES = ["step", "amount", "type_CASH_IN", "type_CASH_OUT", "type_DEBIT", "type_PAYMENT",
            "type_TRANSFER", "type2_CC", "type2_CM"]

TXN_STRING_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])
TXN_SCHEMA = T.StructType([
    T.StructField("step", T.IntegerType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("nameOrig", T.StringType(), True),
    T.StructField("oldbalanceOrg", T.DoubleType(), True),
    T.StructField("newbalanceOrig", T.DoubleType(), True),
    T.StructField("nameDest", T.StringType(), True),
    T.StructField("oldbalanceDest", T.DoubleType(), True),
    T.StructField("newbalanceDest", T.DoubleType(), True),
    T.StructField("isFraud", T.IntegerType(), True),
    T.StructField("isFlaggedFraud", T.IntegerType(), True),
])

EPOCH_2024 = 1704067200  # 2024-01-01 00:00:00 UTC, hour 1 of the fixture


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    et = F.col("event_type")
    amount = F.col("value")
    return ev.select(
        F.col("event_id"),
        ((F.floor((F.unix_timestamp("ts") - F.lit(EPOCH_2024)) / 3600)).cast("int") + 1).alias("step"),
        F.when(et == "purchase", "PAYMENT").when(et == "view", "CASH_IN")
         .when(et == "signup", "DEBIT").when(et == "click", "CASH_OUT")
         .otherwise("TRANSFER").alias("type"),
        amount.alias("amount"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("nameOrig"),
        (amount * 2).alias("oldbalanceOrg"),
        amount.alias("newbalanceOrig"),
        F.concat(F.when(et == "purchase", "M").otherwise("C"),
                 (F.col("event_id") * 7919 % 1000).cast("string")).alias("nameDest"),
        F.lit(0.0).alias("oldbalanceDest"),
        amount.alias("newbalanceDest"),
        F.when(et.isin("error", "click") & (amount >= 120), 1).otherwise(0).cast("int").alias("isFraud"),
        F.lit(0).cast("int").alias("isFlaggedFraud"),
    )


def txn_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txn with injected NULLs and a second copy of every 50th row (FIXTURES.md §3)."""
    t = txn(spark, sf_dir)
    k = F.col("event_id")
    t = t.withColumn("amount", F.when(k % 97 == 0, F.lit(None).cast("double")).otherwise(F.col("amount")))
    t = t.withColumn("type", F.when(k % 101 == 0, F.lit(None).cast("string")).otherwise(F.col("type")))
    return t.unionByName(t.filter(k % 50 == 0))


def txn_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txn with day steps and whole amounts: many natural duplicates."""
    t = txn(spark, sf_dir)
    return t.withColumn("step", (F.col("step") / 24).cast("int")) \
            .withColumn("amount", F.col("amount").cast("int").cast("double"))


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-scored table (FIXTURES.md §4): a classifier that needs no model."""
    t = txn(spark, sf_dir)
    return t.select("event_id", F.col("isFraud").alias("label"), F.col("amount").alias("score"),
                    F.when(F.col("amount") >= 120, 1.0).otherwise(0.0).alias("prediction"))


# ---------------------------------------------------------------- DuckDB text
TXN_SQL = """txn AS (
  SELECT event_id,
    CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS INTEGER) + 1 AS step,
    CASE event_type WHEN 'purchase' THEN 'PAYMENT' WHEN 'view' THEN 'CASH_IN' WHEN 'signup' THEN 'DEBIT'
                    WHEN 'click' THEN 'CASH_OUT' ELSE 'TRANSFER' END AS type,
    value AS amount,
    concat('C', CAST(user_id AS VARCHAR)) AS nameOrig,
    value * 2 AS oldbalanceOrg,
    value AS newbalanceOrig,
    concat(CASE WHEN event_type = 'purchase' THEN 'M' ELSE 'C' END, CAST(event_id * 7919 % 1000 AS VARCHAR)) AS nameDest,
    0.0::DOUBLE AS oldbalanceDest,
    value AS newbalanceDest,
    CAST(CASE WHEN event_type IN ('error', 'click') AND value >= 120 THEN 1 ELSE 0 END AS INTEGER) AS isFraud,
    CAST(0 AS INTEGER) AS isFlaggedFraud
  FROM events)"""

TXN_DIRTY_SQL = TXN_SQL + """,
txn_d0 AS (
  SELECT event_id, step,
    CASE WHEN event_id % 101 = 0 THEN NULL ELSE type END AS type,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE amount END AS amount,
    nameOrig, oldbalanceOrg, newbalanceOrig, nameDest, oldbalanceDest, newbalanceDest, isFraud, isFlaggedFraud
  FROM txn),
txn_dirty AS (SELECT * FROM txn_d0 UNION ALL SELECT * FROM txn_d0 WHERE event_id % 50 = 0)"""

TXN_COARSE_SQL = TXN_SQL + """,
txn_coarse AS (
  SELECT event_id, CAST(trunc(step / 24) AS INTEGER) AS step, type,
         CAST(trunc(amount) AS DOUBLE) AS amount, nameOrig, oldbalanceOrg, newbalanceOrig,
         nameDest, oldbalanceDest, newbalanceDest, isFraud, isFlaggedFraud
  FROM txn)"""

FEATURES_SQL = TXN_SQL + """,
feat AS (
  SELECT event_id, step, amount,
    CAST(type = 'CASH_IN' AS INTEGER) AS type_CASH_IN,
    CAST(type = 'CASH_OUT' AS INTEGER) AS type_CASH_OUT,
    CAST(type = 'DEBIT' AS INTEGER) AS type_DEBIT,
    CAST(type = 'PAYMENT' AS INTEGER) AS type_PAYMENT,
    CAST(type = 'TRANSFER' AS INTEGER) AS type_TRANSFER,
    CAST(concat(substr(nameOrig, 1, 1), substr(nameDest, 1, 1)) = 'CC' AS INTEGER) AS type2_CC,
    CAST(concat(substr(nameOrig, 1, 1), substr(nameDest, 1, 1)) = 'CM' AS INTEGER) AS type2_CM,
    isFraud
  FROM txn)"""

RULE_SQL = TXN_SQL + """,
rule AS (
  SELECT event_id, isFraud AS label, amount AS score,
         CASE WHEN amount >= 120 THEN 1.0 ELSE 0.0 END AS prediction
  FROM txn)"""


def rule_classifiers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three model-free classifiers on txn: (label, score, prediction) each."""
    t = txn(spark, sf_dir)
    flag = F.col("type").isin("TRANSFER", "CASH_OUT").cast("double")
    amt = F.col("amount")
    lab = F.col("isFraud").alias("label")
    return {
        "rule_amount": t.select(lab, amt.alias("score"),
                                F.when(amt >= 120, 1.0).otherwise(0.0).alias("prediction")),
        "rule_type": t.select(lab, flag.alias("score"), flag.alias("prediction")),
        "rule_both": t.select(lab, (amt * flag).alias("score"),
                              F.when((amt >= 100) & (flag == 1.0), 1.0).otherwise(0.0).alias("prediction")),
    }


RULES_SQL = TXN_SQL + """,
rule_amount AS (SELECT isFraud AS label, amount AS score,
                       CASE WHEN amount >= 120 THEN 1.0 ELSE 0.0 END AS prediction FROM txn),
rule_type AS (SELECT isFraud AS label, CAST(type IN ('TRANSFER', 'CASH_OUT') AS DOUBLE) AS score,
                     CAST(type IN ('TRANSFER', 'CASH_OUT') AS DOUBLE) AS prediction FROM txn),
rule_both AS (SELECT isFraud AS label, amount * CAST(type IN ('TRANSFER', 'CASH_OUT') AS DOUBLE) AS score,
                     CASE WHEN amount >= 100 AND type IN ('TRANSFER', 'CASH_OUT') THEN 1.0 ELSE 0.0 END AS prediction
              FROM txn)"""
