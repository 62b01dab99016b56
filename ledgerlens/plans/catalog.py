"""The registered queries: one Spark plan per operator of SURVEY §2, each
with the DuckDB SQL that must give the same rows (``None`` = rows-only check).

Every query reads the given tables (or what Spark derives from them) in
full.  Doubles are rounded to 6 decimals on both sides before comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.exprs import rnd
from ..operators import clean, explore, features

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str | None] = {}


def query(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        ORACLES[name] = sql
        return fn
    return deco


def with_(cte: str, body: str) -> str:
    return f"WITH {cte}\n{body}"


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[rnd(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


TXN_COLS = "event_id, step, type, amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest, " \
           "oldbalanceDest, newbalanceDest, isFraud, isFlaggedFraud"


# ======================================================================= S
@query("txn_view", with_(S.TXN_SQL, f"SELECT {TXN_COLS} FROM txn"))
def q_txn_view(spark, d):
    return S.txn(spark, d)


# ======================================================================= P
@query("pair_code", with_(S.TXN_SQL, """
SELECT concat(substr(nameOrig, 1, 1), substr(nameDest, 1, 1)) AS type2, count(*) AS n
FROM txn GROUP BY 1"""))
def q_pair_code(spark, d):
    t = features.pair_code(S.txn(spark, d))
    return t.groupBy("type2").agg(F.count(F.lit(1)).alias("n"))


@query("drop_columns", with_(S.TXN_SQL, """
SELECT event_id, step, type, amount, isFraud FROM txn"""))
def q_drop_columns(spark, d):
    t = S.txn(spark, d)
    # 'types_indexed3' does not exist: ignored, as on the Spark path of the reference
    return features.drop_columns(t, S.ID_COLUMNS + S.BALANCE_COLUMNS + ["types_indexed3"])


@query("cast_amount_int", with_(S.TXN_SQL, """
SELECT event_id, CAST(step AS INTEGER) AS step, CAST(trunc(amount) AS INTEGER) AS amount,
       CAST(isFraud AS INTEGER) AS isFraud
FROM txn"""))
def q_cast_amount_int(spark, d):
    t = S.txn(spark, d).select("event_id", *[F.col(c).cast("string").alias(c)
                                             for c in ("step", "amount", "isFraud")])
    return features.cast_columns(t, {"step": "int", "amount": "int", "isFraud": "int"})


_IDX_SQL = """
WITH c AS (SELECT {col} AS label, count(*) AS n FROM {tab} WHERE {col} IS NOT NULL GROUP BY 1),
i AS (SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS DOUBLE) AS idx FROM c)
SELECT {key}, {col}, i.idx AS {col}_index FROM {tab} JOIN i ON {tab}.{col} = i.label"""


@query("string_index", with_(S.TXN_SQL, _IDX_SQL.format(col="type", tab="txn", key="event_id")
                             .replace("WITH c AS", ", c AS", 1)))
def q_string_index(spark, d):
    t = S.txn(spark, d)
    return features.string_index(t, "type").select("event_id", "type", "type_index")


@query("string_index_customer", _IDX_SQL.format(col="c_name", tab="customer", key="c_custkey"))
def q_string_index_customer(spark, d):
    # a label for each row: the index is a join, with no limit on their number
    c = S.table(spark, d, "customer")
    return features.string_index(c, "c_name").select("c_custkey", "c_name", "c_name_index")


@query("prepare_unseen_type", with_(S.TXN_SQL, """
SELECT event_id, step, amount, CAST(type = 'CASH_IN' AS INTEGER) AS type_CASH_IN,
  CAST(type = 'CASH_OUT' AS INTEGER) AS type_CASH_OUT, CAST(type = 'PAYMENT' AS INTEGER) AS type_PAYMENT,
  CAST(type = 'TRANSFER' AS INTEGER) AS type_TRANSFER, CAST(type = 'DEBIT' AS INTEGER) AS type_WIRE,
  CAST(substr(nameDest, 1, 1) = 'C' AS INTEGER) AS type2_CC, CAST(substr(nameDest, 1, 1) = 'M' AS INTEGER) AS type2_CM,
  isFraud FROM txn"""))
def q_prepare_unseen_type(spark, d):
    from .flow import prepare
    t = S.txn(spark, d)
    return prepare(t.withColumn("type", F.when(F.col("type") == "DEBIT", "WIRE").otherwise(F.col("type"))), dedupe=False)


@query("sample_rows", with_(S.TXN_SQL, f"""
SELECT {TXN_COLS} FROM txn ORDER BY md5(concat('0|', CAST(event_id AS VARCHAR))), event_id LIMIT 4"""))
def q_sample_rows(spark, d):
    return features.sample_rows(S.txn(spark, d), "event_id", 4)


@query("string_index_orders", _IDX_SQL.format(col="o_orderpriority", tab="orders", key="o_orderkey"))
def q_string_index_orders(spark, d):
    o = S.table(spark, d, "orders")
    return features.string_index(o, "o_orderpriority").select(
        "o_orderkey", "o_orderpriority", "o_orderpriority_index")


_CAT_SQL = """
WITH c AS (SELECT {col} AS label, count(*) AS n FROM {tab} WHERE {col} IS NOT NULL GROUP BY 1)
SELECT label AS {col}, n AS count,
       CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS DOUBLE) AS {col}_index FROM c"""


@query("category_index_orders", _CAT_SQL.format(col="o_orderpriority", tab="orders"))
def q_category_index_orders(spark, d):
    return features.category_index_table(S.table(spark, d, "orders"), "o_orderpriority")


@query("category_index_customer", _CAT_SQL.format(col="c_name", tab="customer"))
def q_category_index_customer(spark, d):
    # one label per row: the rank runs distributed, not in one task
    return features.category_index_table(S.table(spark, d, "customer"), "c_name")


@query("one_hot_columns", with_(S.TXN_SQL, """
SELECT event_id, type,
  CAST(type = 'CASH_IN' AS DOUBLE) AS CASH_IN, CAST(type = 'CASH_OUT' AS DOUBLE) AS CASH_OUT,
  CAST(type = 'DEBIT' AS DOUBLE) AS DEBIT, CAST(type = 'PAYMENT' AS DOUBLE) AS PAYMENT,
  CAST(type = 'TRANSFER' AS DOUBLE) AS TRANSFER
FROM txn"""))
def q_one_hot_columns(spark, d):
    t = S.txn(spark, d).select("event_id", "type")
    return features.one_hot_columns(t, "type")


_DUMMIES = """
  CAST(coalesce(type = 'CASH_IN', false) AS INTEGER) AS type_CASH_IN,
  CAST(coalesce(type = 'CASH_OUT', false) AS INTEGER) AS type_CASH_OUT,
  CAST(coalesce(type = 'DEBIT', false) AS INTEGER) AS type_DEBIT,
  CAST(coalesce(type = 'PAYMENT', false) AS INTEGER) AS type_PAYMENT,
  CAST(coalesce(type = 'TRANSFER', false) AS INTEGER) AS type_TRANSFER,
  CAST(coalesce(concat(substr(nameOrig, 1, 1), substr(nameDest, 1, 1)) = 'CC', false) AS INTEGER) AS type2_CC,
  CAST(coalesce(concat(substr(nameOrig, 1, 1), substr(nameDest, 1, 1)) = 'CM', false) AS INTEGER) AS type2_CM"""


@query("get_dummies", with_(S.TXN_SQL, f"""
SELECT event_id, step, amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest, oldbalanceDest,
       newbalanceDest, isFraud, isFlaggedFraud, {_DUMMIES}
FROM txn"""))
def q_get_dummies(spark, d):
    t = features.pair_code(S.txn(spark, d))
    return features.get_dummies(t, ["type", "type2"])


@query("get_dummies_nulls", with_(S.TXN_DIRTY_SQL, """
SELECT event_id, amount,
  CAST(coalesce(type = 'CASH_IN', false) AS INTEGER) AS type_CASH_IN,
  CAST(coalesce(type = 'CASH_OUT', false) AS INTEGER) AS type_CASH_OUT,
  CAST(coalesce(type = 'DEBIT', false) AS INTEGER) AS type_DEBIT,
  CAST(coalesce(type = 'PAYMENT', false) AS INTEGER) AS type_PAYMENT,
  CAST(coalesce(type = 'TRANSFER', false) AS INTEGER) AS type_TRANSFER
FROM txn_dirty"""))
def q_get_dummies_nulls(spark, d):
    t = S.txn_dirty(spark, d).select("event_id", "amount", "type")
    return features.get_dummies(t, ["type"])


@query("one_hot_vector", with_(S.TXN_SQL + """,
c AS (SELECT type AS label, count(*) AS n FROM txn GROUP BY 1),
i AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) - 1 AS idx FROM c)""", """
SELECT event_id, type, """ + ", ".join(f"CAST(idx = {k} AS DOUBLE) AS v{k}" for k in range(5)) + """
FROM txn JOIN i ON txn.type = i.label"""))
def q_one_hot_vector(spark, d):
    t = S.txn(spark, d).select("event_id", "type")
    v = features.one_hot_vector(t, "type", as_array=True)
    return v.select("event_id", "type", *[F.col("type_vec")[k].alias(f"v{k}") for k in range(5)])


@query("assemble", with_(S.FEATURES_SQL, "SELECT event_id, isFraud, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS f{k}" for k, c in enumerate(S.FEATURES)) + " FROM feat"))
def q_assemble(spark, d):
    from pyspark.ml.functions import vector_to_array
    from ..plans.flow import prepared_features
    p = prepared_features(spark, d)
    a = features.assemble(p, S.FEATURES, "features", label=S.LABEL)
    v = a.select("event_id", vector_to_array("features").alias("v"), S.LABEL)
    return v.select("event_id", S.LABEL, *[F.col("v")[k].alias(f"f{k}") for k in range(len(S.FEATURES))])


@query("describe_schema", with_(S.TXN_SQL, " UNION ALL ".join(
    f"SELECT {i + 1} AS position, '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null FROM txn"
    for i, (c, t) in enumerate([("event_id", "bigint"), ("step", "int"), ("type", "string"),
                                ("amount", "double"), ("nameOrig", "string"),
                                ("oldbalanceOrg", "double"), ("newbalanceOrig", "double"),
                                ("nameDest", "string"), ("oldbalanceDest", "double"),
                                ("newbalanceDest", "double"), ("isFraud", "int"),
                                ("isFlaggedFraud", "int")]))))
def q_describe_schema(spark, d):
    return features.describe_schema(S.txn(spark, d))


@query("preview", with_(S.TXN_SQL, f"SELECT {TXN_COLS} FROM txn ORDER BY event_id LIMIT 10"))
def q_preview(spark, d):
    return features.preview(S.txn(spark, d), 10, order_by="event_id")


# ======================================================================= F
@query("class_rows", with_(S.TXN_SQL, f"SELECT {TXN_COLS} FROM txn WHERE isFraud = 1"))
def q_class_rows(spark, d):
    return clean.class_rows(S.txn(spark, d), "isFraud", 1)


_DIRTY_FEATS = "step, type, amount, isFraud"


@query("duplicate_count", with_(S.TXN_DIRTY_SQL, f"""
SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(c - 1) AS BIGINT) AS n_duplicates
FROM (SELECT {_DIRTY_FEATS}, count(*) AS c FROM txn_dirty GROUP BY ALL)"""))
def q_duplicate_count(spark, d):
    t = S.txn_dirty(spark, d).select(*_DIRTY_FEATS.split(", "))
    return clean.duplicate_count(t)


@query("duplicate_count_coarse", with_(S.TXN_COARSE_SQL, f"""
SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(c - 1) AS BIGINT) AS n_duplicates
FROM (SELECT {_DIRTY_FEATS}, count(*) AS c FROM txn_coarse GROUP BY ALL)"""))
def q_duplicate_count_coarse(spark, d):
    t = S.txn_coarse(spark, d).select(*_DIRTY_FEATS.split(", "))
    return clean.duplicate_count(t)


@query("drop_nulls", with_(S.TXN_DIRTY_SQL, f"""
SELECT event_id, {_DIRTY_FEATS} FROM txn_dirty WHERE type IS NOT NULL AND amount IS NOT NULL"""))
def q_drop_nulls(spark, d):
    t = S.txn_dirty(spark, d).select("event_id", *_DIRTY_FEATS.split(", "))
    return clean.drop_nulls(t)


@query("drop_duplicates", with_(S.TXN_COARSE_SQL, f"""
SELECT {_DIRTY_FEATS}, min(event_id) AS event_id FROM txn_coarse GROUP BY ALL"""))
def q_drop_duplicates(spark, d):
    t = S.txn_coarse(spark, d).select("event_id", *_DIRTY_FEATS.split(", "))
    return clean.drop_duplicates(t, keep_by="event_id")


@query("drop_duplicates_dirty", with_(S.TXN_DIRTY_SQL, f"""
SELECT {_DIRTY_FEATS}, min(event_id) AS event_id FROM txn_dirty GROUP BY ALL"""))
def q_drop_duplicates_dirty(spark, d):
    t = S.txn_dirty(spark, d).select("event_id", *_DIRTY_FEATS.split(", "))
    return clean.drop_duplicates(t, keep_by="event_id")


# ======================================================================= A
@query("row_count", with_(S.TXN_SQL, "SELECT count(*) AS n_rows FROM txn"))
def q_row_count(spark, d):
    return explore.row_count(S.txn(spark, d))


@query("value_counts", with_(S.TXN_SQL, """
SELECT type, count(*) AS count, round(count(*) / (SELECT count(*) FROM txn), 6) AS share
FROM txn GROUP BY type"""))
def q_value_counts(spark, d):
    return explore.value_counts(S.txn(spark, d), "type")


@query("value_counts_lineitem", """
SELECT l_returnflag, count(*) AS count, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share
FROM lineitem GROUP BY l_returnflag""")
def q_value_counts_lineitem(spark, d):
    return explore.value_counts(S.table(spark, d, "lineitem"), "l_returnflag")


@query("class_balance", with_(S.TXN_SQL, """
SELECT greatest(p, n) AS n_majority, least(p, n) AS n_minority,
       round(CASE WHEN least(p, n) > 0 THEN greatest(p, n) / least(p, n) END, 6) AS ratio
FROM (SELECT CAST(sum(CASE WHEN isFraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS p,
             CAST(sum(CASE WHEN isFraud = 1 THEN 0 ELSE 1 END) AS BIGINT) AS n FROM txn)"""))
def q_class_balance(spark, d):
    return explore.class_balance(S.txn(spark, d), "isFraud")


def _hist_sql(src: str, cols: list[str], bins: int) -> str:
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS column_name, g.bin,
  round(s.lo + g.bin * ((s.hi - s.lo) / s.nb), 6) AS lo,
  round(CASE WHEN g.bin = s.nb - 1 THEN s.hi ELSE s.lo + (g.bin + 1) * ((s.hi - s.lo) / s.nb) END, 6) AS hi,
  (SELECT count(*) FROM {src} x WHERE x.{c} IS NOT NULL AND
     CASE WHEN s.hi = s.lo THEN 0
          ELSE least(floor((CAST(x.{c} AS DOUBLE) - s.lo) / ((s.hi - s.lo) / s.nb)), s.nb - 1) END = g.bin) AS count
FROM (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi,
             CASE WHEN min({c}) = max({c}) THEN 1 ELSE {bins} END AS nb FROM {src}) s,
     LATERAL (SELECT CAST(range AS INTEGER) AS bin FROM range(s.nb)) g""")
    return " UNION ALL ".join(parts)


def _hist_sql_nocol(src: str, c: str, bins: int) -> str:
    return f"SELECT bin, lo, hi, count FROM ({_hist_sql(src, [c], bins)})"


@query("histogram_amount", with_(S.TXN_SQL, _hist_sql_nocol("txn", "amount", 15)))
def q_histogram_amount(spark, d):
    return round_doubles(explore.histogram(S.txn(spark, d), "amount", 15))


@query("histogram_140", with_(S.TXN_SQL, _hist_sql_nocol("txn", "amount", 140)))
def q_histogram_140(spark, d):
    return round_doubles(explore.histogram(S.txn(spark, d), "amount", 140))


@query("histogram_isfraud", with_(S.TXN_SQL, _hist_sql_nocol("txn", "isFraud", 15)))
def q_histogram_isfraud(spark, d):
    return round_doubles(explore.histogram(S.txn(spark, d), "isFraud", 15))


@query("histograms_multi", with_(S.FEATURES_SQL, _hist_sql("feat", S.FEATURES + ["isFraud"], 15)))
def q_histograms_multi(spark, d):
    from ..plans.flow import prepared_features
    p = prepared_features(spark, d)
    return round_doubles(explore.histograms(p, S.FEATURES + ["isFraud"], 15))


@query("histogram_lineitem", _hist_sql_nocol("lineitem", "l_extendedprice", 10))
def q_histogram_lineitem(spark, d):
    return round_doubles(explore.histogram(S.table(spark, d, "lineitem"), "l_extendedprice", 10))


def _quartile_sql(src: str, c: str) -> str:
    return f"""
SELECT '{c}' AS column_name, q1, median, q3, q3 - q1 AS iqr,
  (SELECT min(CAST({c} AS DOUBLE)) FROM {src} WHERE {c} >= q1 - 1.5 * (q3 - q1)) AS whisker_lo,
  (SELECT max(CAST({c} AS DOUBLE)) FROM {src} WHERE {c} <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
  (SELECT count(*) FROM {src} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median,
             quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {src})"""


@query("box_stats", with_(S.TXN_SQL, "SELECT column_name, round(q1, 6) AS q1, round(median, 6) AS median, "
                          "round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(whisker_lo, 6) AS whisker_lo, "
                          "round(whisker_hi, 6) AS whisker_hi, n_outliers FROM (" +
                          " UNION ALL ".join(_quartile_sql("txn", c) for c in ("isFraud", "amount", "step"))
                          + ")"))
def q_box_stats(spark, d):
    return round_doubles(explore.box_stats(S.txn(spark, d), ["isFraud", "amount", "step"]))


@query("box_stats_lineitem", "SELECT column_name, round(q1, 6) AS q1, round(median, 6) AS median, "
       "round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(whisker_lo, 6) AS whisker_lo, "
       "round(whisker_hi, 6) AS whisker_hi, n_outliers FROM (" +
       " UNION ALL ".join(_quartile_sql("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_discount"))
       + ")")
def q_box_stats_lineitem(spark, d):
    return round_doubles(explore.box_stats(S.table(spark, d, "lineitem"),
                                           ["l_quantity", "l_extendedprice", "l_discount"]))


# ======================================================================= E (rule-scored table)
from ..operators import choose, corr, evaluate, split  # noqa: E402

_CUM_SQL = """
g AS (SELECT CAST(score AS DOUBLE) AS score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
             CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg
      FROM {src} WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY 1),
c AS (SELECT score, pos, neg,
             sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
             row_number() OVER (ORDER BY score DESC) AS r
      FROM g),
t AS (SELECT sum(pos) AS P, sum(neg) AS N, count(*) AS nd FROM g)"""


def _auc_sql(src: str) -> str:
    """AUC by the rank formula (average ranks), independent of the Spark algorithm."""
    return f"""
(SELECT (s - P * (P + 1) / 2.0) / (P * N) FROM (
   SELECT sum(CASE WHEN label = 1 THEN rk + (c - 1) / 2.0 END) AS s,
          sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS P, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS N
   FROM (SELECT label, rank() OVER (ORDER BY score) AS rk, count(*) OVER (PARTITION BY score) AS c
         FROM {src} WHERE score IS NOT NULL AND label IS NOT NULL)))"""


def _metrics_sql(src: str, p: str) -> str:
    """CTEs {p}cm .. {p}m computing n, accuracy, weighted precision/recall/F1, balanced accuracy."""
    return f"""
{p}cm AS (SELECT CAST(label AS DOUBLE) AS l, CAST(prediction AS DOUBLE) AS pr, count(*) AS c FROM {src} GROUP BY ALL),
{p}act AS (SELECT l, sum(c) AS actual, sum(CASE WHEN l = pr THEN c ELSE 0 END) AS tp FROM {p}cm GROUP BY l),
{p}prd AS (SELECT pr AS l, sum(c) AS predicted FROM {p}cm GROUP BY pr),
{p}per AS (SELECT a.actual, a.tp,
                  CASE WHEN coalesce(b.predicted, 0) > 0 THEN a.tp / b.predicted ELSE 0.0 END AS pp,
                  a.tp / a.actual AS rr
           FROM {p}act a LEFT JOIN {p}prd b ON a.l = b.l),
{p}m AS (SELECT CAST(sum(actual) AS BIGINT) AS n, sum(tp) / sum(actual) AS accuracy,
                sum(actual * pp) / sum(actual) AS weighted_precision,
                sum(actual * rr) / sum(actual) AS weighted_recall,
                sum(actual * CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0.0 END) / sum(actual) AS weighted_f1,
                avg(rr) AS balanced_accuracy
         FROM {p}per)"""


@query("auc_roc", with_(S.RULE_SQL, f"SELECT round({_auc_sql('rule')}, 6) AS auc_roc"))
def q_auc_roc(spark, d):
    return round_doubles(evaluate.auc_roc(S.rule_scores(spark, d)))


@query("curve_area", with_(S.RULE_SQL, f"SELECT round({_auc_sql('rule')}, 6) AS area"))
def q_curve_area(spark, d):
    return round_doubles(evaluate.curve_area(S.rule_scores(spark, d)))


@query("balanced_accuracy", with_(S.RULE_SQL + "," + _metrics_sql("rule", "x_"),
                                  "SELECT round(balanced_accuracy, 6) AS balanced_accuracy FROM x_m"))
def q_balanced_accuracy(spark, d):
    return round_doubles(evaluate.balanced_accuracy(S.rule_scores(spark, d)))


@query("classification_metrics", with_(S.RULE_SQL + "," + _metrics_sql("rule", "x_"), """
SELECT n, round(accuracy, 6) AS accuracy, round(weighted_precision, 6) AS weighted_precision,
       round(weighted_recall, 6) AS weighted_recall, round(weighted_f1, 6) AS weighted_f1,
       round(balanced_accuracy, 6) AS balanced_accuracy FROM x_m"""))
def q_classification_metrics(spark, d):
    return round_doubles(evaluate.classification_metrics(S.rule_scores(spark, d)))


@query("confusion_matrix", with_(S.RULE_SQL, """
SELECT CAST(label AS DOUBLE) AS label, CAST(prediction AS DOUBLE) AS prediction, count(*) AS count
FROM rule GROUP BY ALL"""))
def q_confusion_matrix(spark, d):
    return evaluate.confusion_matrix(S.rule_scores(spark, d))


@query("confusion_matrix_wide", with_(S.RULE_SQL, """
SELECT CAST(label AS DOUBLE) AS label,
       CAST(sum(CASE WHEN prediction = 0.0 THEN 1 ELSE 0 END) AS BIGINT) AS pred_0,
       CAST(sum(CASE WHEN prediction = 1.0 THEN 1 ELSE 0 END) AS BIGINT) AS pred_1
FROM rule GROUP BY 1"""))
def q_confusion_matrix_wide(spark, d):
    return evaluate.confusion_matrix_wide(S.rule_scores(spark, d))


@query("roc_curve", with_(S.RULE_SQL + "," + _CUM_SQL.format(src="rule"), """
SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT score, round(fp / N, 6), round(tp / P, 6) FROM c, t"""))
def q_roc_curve(spark, d):
    return round_doubles(evaluate.roc_curve(S.rule_scores(spark, d)))


@query("roc_curve_binned", with_(S.RULE_SQL + "," + _CUM_SQL.format(src="rule"), """
SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT score, round(fp / N, 6), round(tp / P, 6)
FROM (SELECT c.*, P, N, floor((r - 1) * 20 / nd) AS grp,
             max(r) OVER (PARTITION BY floor((r - 1) * 20 / nd)) AS last_r FROM c, t)
WHERE r = last_r"""))
def q_roc_curve_binned(spark, d):
    return round_doubles(evaluate.roc_curve(S.rule_scores(spark, d), bins=20))


@query("pr_curve", with_(S.RULE_SQL + "," + _CUM_SQL.format(src="rule"), """
SELECT score AS threshold, round(tp / P, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM c, t"""))
def q_pr_curve(spark, d):
    return round_doubles(evaluate.pr_curve(S.rule_scores(spark, d)))


def _compare_sql() -> str:
    names = ["rule_amount", "rule_type", "rule_both"]
    ctes = ",".join(_metrics_sql(n, f"{n}_") for n in names)
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS name_model, accuracy, weighted_precision AS precision, weighted_recall AS recall, "
        f"{_auc_sql(n)} AS auc_roc FROM {n}_m" for n in names)
    return S.RULES_SQL + "," + ctes + f", cmp AS ({rows})"


@query("compare_models", with_(_compare_sql(), """
SELECT name_model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(auc_roc, 6) AS auc_roc FROM cmp"""))
def q_compare_models(spark, d):
    return round_doubles(choose.compare_models(S.rule_classifiers(spark, d)))


@query("compare_models_transposed", with_(_compare_sql(), " UNION ALL ".join(
    f"""SELECT '{m}' AS metric,
  round(max(CASE WHEN name_model = 'rule_amount' THEN {m} END), 6) AS rule_amount,
  round(max(CASE WHEN name_model = 'rule_type' THEN {m} END), 6) AS rule_type,
  round(max(CASE WHEN name_model = 'rule_both' THEN {m} END), 6) AS rule_both FROM cmp"""
    for m in choose.METRICS)))
def q_compare_models_transposed(spark, d):
    rules = S.rule_classifiers(spark, d)
    return round_doubles(choose.compare_models(rules, transpose=True))


@query("select_model", with_(_compare_sql(), """
SELECT name_model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(auc_roc, 6) AS auc_roc
FROM cmp ORDER BY auc_roc DESC, name_model LIMIT 1"""))
def q_select_model(spark, d):
    table = choose.compare_models(S.rule_classifiers(spark, d))
    return round_doubles(choose.select_model(table, "auc_roc"))


# ======================================================================= Q
def _pearson_sql(x: str, y: str) -> str:
    return (f"CASE WHEN var_pop(CAST({x} AS DOUBLE)) > 0 AND var_pop(CAST({y} AS DOUBLE)) > 0 "
            f"THEN greatest(-1.0, least(1.0, corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)))) END")


_CORR_COLS = S.FEATURES + [S.LABEL]


@query("target_correlation", with_(S.FEATURES_SQL, " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round({_pearson_sql('isFraud', f)}, 6) AS correlation, "
    f"round(abs({_pearson_sql('isFraud', f)}), 6) AS abs_correlation FROM feat" for f in S.FEATURES)))
def q_target_correlation(spark, d):
    from .flow import prepared_features
    p = prepared_features(spark, d)
    return round_doubles(corr.target_correlation(p, S.LABEL, S.FEATURES))


@query("all_target_correlations", with_(S.FEATURES_SQL, " UNION ALL ".join(
    f"SELECT '{a}' AS target, '{b}' AS feature, round({_pearson_sql(a, b)}, 6) AS correlation, "
    f"round(abs({_pearson_sql(a, b)}), 6) AS abs_correlation FROM feat"
    for a in _CORR_COLS for b in _CORR_COLS if a != b)))
def q_all_target_correlations(spark, d):
    from .flow import prepared_features
    p = prepared_features(spark, d)
    return round_doubles(corr.all_target_correlations(p, _CORR_COLS))


_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlation_matrix_pearson", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, round({_pearson_sql(a, b)}, 6) AS correlation FROM lineitem"
    for a in _LI_NUM for b in _LI_NUM))
def q_correlation_matrix_pearson(spark, d):
    return round_doubles(corr.correlation_matrix(S.table(spark, d, "lineitem"), _LI_NUM))


@query("correlation_matrix_spearman", "WITH rk AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _LI_NUM)
    + " FROM lineitem WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _LI_NUM) + ")\n" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, round({_pearson_sql(a, b)}, 6) AS correlation FROM rk"
    for a in _LI_NUM for b in _LI_NUM))
def q_correlation_matrix_spearman(spark, d):
    return round_doubles(corr.correlation_matrix(S.table(spark, d, "lineitem"), _LI_NUM, "spearman"))


@query("correlation_wide_embeddings", """
WITH long AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
SELECT concat('e', CAST(a.i - 1 AS VARCHAR)) AS feature_x, concat('e', CAST(b.i - 1 AS VARCHAR)) AS feature_y,
       round(corr(a.v, b.v), 6) AS correlation FROM long a JOIN long b ON a.vec_id = b.vec_id GROUP BY a.i, b.i""")
def q_correlation_wide_embeddings(spark, d):
    return round_doubles(corr.correlation_matrix(_embeddings_wide(spark, d), _EMB))


@query("top_features", with_(S.FEATURES_SQL, "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round({_pearson_sql('isFraud', f)}, 6) AS correlation, "
    f"round(abs({_pearson_sql('isFraud', f)}), 6) AS abs_correlation FROM feat" for f in S.FEATURES)
    + ") ORDER BY abs_correlation DESC NULLS LAST, feature LIMIT 3"))
def q_top_features(spark, d):
    from .flow import prepared_features
    p = prepared_features(spark, d)
    return round_doubles(corr.top_features(p, S.LABEL, S.FEATURES, 3))


# ======================================================================= M1
_U_SQL = "CAST(('0x' || substr(md5(concat({seed}, '|', CAST({key} AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0"


@query("split_hash", with_(S.TXN_SQL, f"""
SELECT event_id, CASE WHEN {_U_SQL.format(seed="'0'", key='event_id')} < 0.7 THEN 'train' ELSE 'test' END AS split
FROM txn"""))
def q_split_hash(spark, d):
    return split.assign_split(S.txn(spark, d).select("event_id"), "event_id", 0.7, seed=0)


@query("split_stratified", with_(S.TXN_SQL, f"""
SELECT event_id, isFraud,
  CASE WHEN row_number() OVER (PARTITION BY isFraud ORDER BY u, event_id)
            <= round(count(*) OVER (PARTITION BY isFraud) * 0.7) THEN 'train' ELSE 'test' END AS split
FROM (SELECT event_id, isFraud, {_U_SQL.format(seed="'0'", key='event_id')} AS u FROM txn)"""))
def q_split_stratified(spark, d):
    t = S.txn(spark, d).select("event_id", "isFraud")
    return split.assign_split(t, "event_id", 0.7, seed=0, stratify="isFraud")


_NULL_LABEL = "CASE WHEN event_id % 7 <> 0 THEN isFraud END"


@query("split_stratified_nulls", with_(S.TXN_SQL, f"""
SELECT event_id, label,
  CASE WHEN row_number() OVER (PARTITION BY label ORDER BY u, event_id)
            <= round(count(*) OVER (PARTITION BY label) * 0.7) THEN 'train' ELSE 'test' END AS split
FROM (SELECT event_id, {_NULL_LABEL} AS label, {_U_SQL.format(seed="'0'", key='event_id')} AS u FROM txn)"""))
def q_split_stratified_nulls(spark, d):
    # rows without a label are a class of their own
    t = S.txn(spark, d).select("event_id", F.expr(_NULL_LABEL).alias("label"))
    return split.assign_split(t, "event_id", 0.7, seed=0, stratify="label")


@query("fold_assignment", with_(S.TXN_SQL, f"""
SELECT event_id, CAST(least(floor({_U_SQL.format(seed="'fold0'", key='event_id')} * 3), 2) AS INTEGER) AS fold
FROM txn"""))
def q_fold_assignment(spark, d):
    return split.assign_folds(S.txn(spark, d).select("event_id"), "event_id", 3, seed=0)


# ======================================================================= B
from ..operators import balance, knn  # noqa: E402

_INT_FEATS = [f for f in S.FEATURES if f != "amount"]
_H_SQL = ("CAST(('0x' || substr(md5(concat('{seed}', '|', '{tag}', '|', CAST({i} AS VARCHAR))), 1, {digits})) "
          "AS BIGINT)")


def _d2_sql(a: str, b: str, cols: list[str]) -> str:
    return " + ".join(f"(CAST({a}.{c} AS DOUBLE) - CAST({b}.{c} AS DOUBLE)) * "
                      f"(CAST({a}.{c} AS DOUBLE) - CAST({b}.{c} AS DOUBLE))" for c in cols)


def _knn_sql(src: str, key: str, cols: list[str], k: int) -> str:
    """Brute force over all pairs: fine for the small oracle fixture only."""
    return f"""SELECT {key}, CAST(r AS INTEGER) AS neighbor_rank, neighbor_key, sqrt(d2) AS distance FROM (
  SELECT a.{key} AS {key}, b.{key} AS neighbor_key, d2,
         row_number() OVER (PARTITION BY a.{key} ORDER BY d2, b.{key}) AS r
  FROM (SELECT a.{key} AS ak, b.{key} AS bk, {_d2_sql('a', 'b', cols)} AS d2
        FROM {src} a JOIN {src} b ON a.{key} <> b.{key}) pr
  JOIN {src} a ON a.{key} = pr.ak JOIN {src} b ON b.{key} = pr.bk) WHERE r <= {k}"""


_MINO_SQL = S.FEATURES_SQL + f""",
mino AS (SELECT event_id, {', '.join(S.FEATURES)} FROM feat WHERE isFraud = 1)"""


@query("knn_within", with_(_MINO_SQL, f"""
SELECT event_id, neighbor_rank, neighbor_key, round(distance, 6) AS distance
FROM ({_knn_sql('mino', 'event_id', S.FEATURES, 5)})"""))
def q_knn_within(spark, d):
    from .flow import prepared_features
    m = prepared_features(spark, d).filter(F.col(S.LABEL) == 1)
    return round_doubles(knn.knn_within(m, "event_id", S.FEATURES, 5))


def _smote_sql(src_cte: str, src: str, mino: str, key: str, cols: list[str], label: str, minority: int,
               int_cols: list[str], seed: int = 42, k: int = 5) -> str:
    h = lambda tag, digits: _H_SQL.format(seed=seed, tag=tag, i="i", digits=digits)
    outs = []
    for c in cols:
        v = f"CAST(b.{c} AS DOUBLE) + u * (CAST(n.{c} AS DOUBLE) - CAST(b.{c} AS DOUBLE))"
        outs.append(f"CAST(trunc({v}) AS INTEGER) AS {c}" if c in int_cols else f"round({v}, 6) AS {c}")
    return with_(src_cte + f""",
cnt AS (SELECT CAST(sum(CASE WHEN {label} <> {minority} THEN 1 ELSE 0 END) AS BIGINT) AS maj,
               CAST(sum(CASE WHEN {label} = {minority} THEN 1 ELSE 0 END) AS BIGINT) AS mn FROM {src}),
nb AS ({_knn_sql(mino, key, cols, k)}),
idx AS (SELECT *, row_number() OVER (ORDER BY {key}) AS kidx FROM {mino}),
gen AS (SELECT i, {h('b', 15)} % mn + 1 AS kidx, CAST({h('k', 15)} % {k} + 1 AS INTEGER) AS nr,
               {h('g', 8)} / 4294967296.0 AS u
        FROM (SELECT unnest(range(maj - mn)) AS i, mn FROM cnt))""", f"""
SELECT gen.i AS synthetic_id, {', '.join(outs)}, CAST({minority} AS INTEGER) AS {label}
FROM gen JOIN idx b ON gen.kidx = b.kidx
JOIN nb ON nb.{key} = b.{key} AND nb.neighbor_rank = gen.nr
JOIN {mino} n ON n.{key} = nb.neighbor_key""")


@query("smote", _smote_sql(_MINO_SQL, "feat", "mino", "event_id", S.FEATURES, "isFraud", 1, _INT_FEATS))
def q_smote(spark, d):
    from .flow import prepared_features
    p = prepared_features(spark, d)
    return round_doubles(balance.smote(p, S.LABEL, S.FEATURES, "event_id", k=5, seed=42,
                                       int_cols=_INT_FEATS))


_EMB = [f"e{i}" for i in range(64)]
_EMB_SQL = "emb AS (SELECT vec_id, label, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(64)) + " FROM embeddings),\n" \
    "emin AS (SELECT * FROM emb WHERE label = 0)"


def _embeddings_wide(spark, d):
    e = S.table(spark, d, "embeddings")
    fits = F.when(F.size("embedding") == 64, F.col("embedding")).otherwise(
        F.raise_error(F.lit("an embedding does not have 64 elements")))
    return e.select("vec_id", "label", fits.alias("v")).select(
        "vec_id", "label", *[F.col("v")[i].cast("double").alias(f"e{i}") for i in range(64)])


@query("smote_embeddings", _smote_sql(_EMB_SQL, "emb", "emin", "vec_id", _EMB, "label", 0, []))
def q_smote_embeddings(spark, d):
    return round_doubles(balance.smote(_embeddings_wide(spark, d), "label", _EMB, "vec_id", k=5, seed=42,
                                       minority=0))


@query("knn_embeddings", with_(_EMB_SQL, f"""
SELECT vec_id, neighbor_rank, neighbor_key, round(distance, 6) AS distance
FROM ({_knn_sql('emin', 'vec_id', _EMB, 5)})"""))
def q_knn_embeddings(spark, d):
    m = _embeddings_wide(spark, d).filter(F.col("label") == 0)
    return round_doubles(knn.knn_within(m, "vec_id", _EMB, 5))


@query("knn_embeddings_all", with_(_EMB_SQL, f"""
SELECT vec_id, neighbor_rank, neighbor_key, round(distance, 6) AS distance
FROM ({_knn_sql('emb', 'vec_id', _EMB, 5)})"""))
def q_knn_embeddings_all(spark, d):
    # the whole table; within each label it is knn_embeddings
    return round_doubles(knn.knn_within(_embeddings_wide(spark, d), "vec_id", _EMB, 5))


@query("knn_approximate_embeddings", None)
def q_knn_approximate_embeddings(spark, d):
    return round_doubles(knn.knn_within(_embeddings_wide(spark, d), "vec_id", _EMB, 5, strategy="approximate", leaf=256))


def _oversample_sql(src: str, key: str, label: str, cols: str, seed: int = 88) -> str:
    u = f"CAST(('0x' || substr(md5(concat('{seed}', '|', 'r', '|', CAST({key} AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0"
    return f"""
cnt AS (SELECT sum(CASE WHEN {label} <> 1 THEN 1 ELSE 0 END) AS maj,
               sum(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS mn FROM {src}),
rr AS (SELECT CAST(maj AS DOUBLE) / mn / 1.0 AS r FROM cnt)
SELECT {cols}, 1 AS copy FROM {src} WHERE {label} <> 1 OR {label} IS NULL
UNION ALL
SELECT {cols}, CAST(c.copy AS INTEGER) AS copy
FROM {src}, rr, LATERAL (SELECT unnest(range(1, CAST(floor(rr.r) AS BIGINT)
      + CASE WHEN {u} < rr.r - floor(rr.r) THEN 1 ELSE 0 END + 1)) AS copy) c
WHERE {label} = 1"""


@query("oversample_replicate", with_(S.TXN_SQL + "," + _oversample_sql(
    "txn", "event_id", "isFraud", "event_id, amount, isFraud").replace("\ncnt AS", "cnt AS", 1), ""))
def q_oversample_replicate(spark, d):
    t = S.txn(spark, d).select("event_id", "amount", "isFraud")
    return balance.oversample_minority(t, "isFraud", "event_id", ratio=1.0)


@query("oversample_labels", "WITH " + _oversample_sql("labels", "doc_id", "toxic", "doc_id, quality, toxic")
       .replace("\ncnt AS", "cnt AS", 1))
def q_oversample_labels(spark, d):
    t = S.table(spark, d, "labels")
    return balance.oversample_minority(t, "toxic", "doc_id", ratio=1.0)


def _poisson_sql(src: str, key: str, label: str, cols: str, seed: int = 88) -> str:
    """Copies by the inverse Poisson distribution at the key's hash, thresholds by recursion."""
    u = _U_SQL.format(seed=f"'{seed}|p'", key=key)
    return f"""WITH RECURSIVE cnt AS (
  SELECT CAST(sum(CASE WHEN {label} <> 1 THEN 1 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS r
  FROM {src}),
cdf AS (SELECT 0 AS i, exp(-r) AS term, exp(-r) AS total, r FROM cnt
        UNION ALL SELECT i + 1, term * r / (i + 1), total + term * r / (i + 1), r FROM cdf WHERE i < 200),
own AS (SELECT {cols}, (SELECT count(*) FROM cdf WHERE total <= {u}) AS n FROM {src} WHERE {label} = 1)
SELECT {cols}, 1 AS copy FROM {src} WHERE {label} <> 1 OR {label} IS NULL
UNION ALL SELECT {cols}, CAST(c.copy AS INTEGER) AS copy FROM own, LATERAL (SELECT unnest(range(1, n + 1)) AS copy) c"""


@query("oversample_random", _poisson_sql("labels", "doc_id", "toxic", "doc_id, quality, toxic"))
def q_oversample_random(spark, d):
    t = S.table(spark, d, "labels")
    return balance.oversample_minority(t, "toxic", "doc_id", ratio=1.0, mode="random", seed=88)


def _deduped_sql(src: str, cols: list[str], key: str = "event_id") -> str:
    return f"SELECT min({key}) AS {key}, {', '.join(cols)} FROM {src} GROUP BY ALL"


def _round_sql(src: str, p: str, seed: int, int_cols: list[str], k: int = 5) -> str:
    """CTEs of one balancing round over ``src`` (event_id, features, isFraud); {p}out is its
    deduplicated result.  Neighbours are found for the bases that are drawn."""
    h = lambda tag, digits: _H_SQL.format(seed=seed, tag=tag, i="i", digits=digits)
    outs = []
    for c in S.FEATURES:
        v = f"CAST(b.{c} AS DOUBLE) + u * (CAST(n.{c} AS DOUBLE) - CAST(b.{c} AS DOUBLE))"
        outs.append(f"CAST(trunc({v}) AS INTEGER) AS {c}" if c in int_cols else f"{v} AS {c}")
    return f"""
{p}min AS (SELECT *, row_number() OVER (ORDER BY event_id) AS kidx FROM {src} WHERE isFraud = 1),
{p}cnt AS (SELECT greatest(0, CAST(sum(1 - 2 * isFraud) AS BIGINT)) AS n_new, CAST(sum(isFraud) AS BIGINT) AS mn,
                  max(event_id) AS top FROM {src}),
{p}gen AS (SELECT i, top, {h('b', 15)} % mn + 1 AS kidx, CAST({h('k', 15)} % {k} + 1 AS INTEGER) AS nr,
                  {h('g', 8)} / 4294967296.0 AS u FROM (SELECT unnest(range(n_new)) AS i, mn, top FROM {p}cnt)),
{p}nb AS (SELECT ak, bk, row_number() OVER (PARTITION BY ak ORDER BY d2, bk) AS nr
          FROM (SELECT a.event_id AS ak, b.event_id AS bk, {_d2_sql('a', 'b', S.FEATURES)} AS d2
                FROM {p}min a JOIN {p}min b ON a.event_id <> b.event_id
                WHERE a.kidx IN (SELECT kidx FROM {p}gen)) QUALIFY nr <= {k}),
{p}syn AS (SELECT top + 1 + i AS event_id, {', '.join(outs)}, 1 AS isFraud
           FROM {p}gen g JOIN {p}min b ON b.kidx = g.kidx JOIN {p}nb x ON x.ak = b.event_id AND x.nr = g.nr
           JOIN {p}min n ON n.event_id = x.bk),
{p}all AS (SELECT event_id, {', '.join(S.FEATURES)}, isFraud FROM {src} UNION ALL
           SELECT event_id, {', '.join(S.FEATURES)}, isFraud FROM {p}syn),
{p}out AS ({_deduped_sql(f"{p}all", [*S.FEATURES, "isFraud"])})"""


_BALANCED_COLS = "event_id, step, round(amount, 6) AS amount, " + ", ".join(S.FEATURES[2:]) + ", isFraud"


@query("balance_two_rounds", with_(S.FEATURES_SQL + "," + _round_sql("feat", "a_", 42, _INT_FEATS) + ","
                                   + _round_sql("a_out", "b_", 43, _INT_FEATS), f"SELECT {_BALANCED_COLS} FROM b_out"))
def q_balance_two_rounds(spark, d):
    from .flow import prepared_features
    p = prepared_features(spark, d)
    return round_doubles(balance.balance(p, S.LABEL, S.FEATURES, "event_id", rounds=2, dedupe=True,
                                         int_cols=_INT_FEATS))


_CATS_SQL = S.TXN_SQL + """,
tx AS (SELECT event_id, step, amount, type, concat(substr(nameOrig, 1, 1), substr(nameDest, 1, 1)) AS type2, isFraud FROM txn),
mc AS (SELECT *, row_number() OVER (ORDER BY event_id) AS kidx FROM tx WHERE isFraud = 1)"""


def _smote_mixed_sql(select: str, seed: int = 42, k: int = 5) -> str:
    """Mixed distance: a category that differs counts the squared median of the numeric
    columns' deviations; categories by majority of the k neighbours, ties by label."""
    h = lambda tag, digits: _H_SQL.format(seed=seed, tag=tag, i="i", digits=digits)
    vote = lambda c: f"""SELECT ak, {c} FROM (SELECT ak, {c}, count(*) AS c FROM nb JOIN mc ON mc.event_id = bk GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY ak ORDER BY c DESC, {c}) = 1"""  # noqa: E731
    differ = " + ".join(f"CASE WHEN a.{c} <> b.{c} THEN pp ELSE 0 END + CASE WHEN a.{c} <> b.{c} THEN pp ELSE 0 END"
                        for c in ("type", "type2"))
    return with_(_CATS_SQL + f""",
pen AS (SELECT p * p AS pp FROM (SELECT (stddev_pop(CAST(step AS DOUBLE)) + stddev_pop(amount)) / 2 / sqrt(2) AS p FROM mc)),
cnt AS (SELECT CAST(sum(1 - 2 * isFraud) AS BIGINT) AS n_new, CAST(sum(isFraud) AS BIGINT) AS mn FROM tx),
gen AS (SELECT i, {h('b', 15)} % mn + 1 AS kidx, CAST({h('k', 15)} % {k} + 1 AS INTEGER) AS nr,
               {h('g', 8)} / 4294967296.0 AS u FROM (SELECT unnest(range(n_new)) AS i, mn FROM cnt)),
nb AS (SELECT ak, bk, row_number() OVER (PARTITION BY ak ORDER BY d2, bk) AS nr
       FROM (SELECT a.event_id AS ak, b.event_id AS bk, {_d2_sql('a', 'b', ['step', 'amount'])} + {differ} AS d2
             FROM mc a JOIN mc b ON a.event_id <> b.event_id, pen) QUALIFY nr <= {k}),
v1 AS ({vote('type')}), v2 AS ({vote('type2')}),
syn AS (SELECT g.i AS synthetic_id,
          CAST(trunc(CAST(b.step AS DOUBLE) + u * (CAST(n.step AS DOUBLE) - CAST(b.step AS DOUBLE))) AS INTEGER) AS step,
          round(b.amount + u * (n.amount - b.amount), 6) AS amount, v1.type, v2.type2, 1 AS isFraud
        FROM gen g JOIN mc b ON b.kidx = g.kidx JOIN nb ON nb.ak = b.event_id AND nb.nr = g.nr
        JOIN mc n ON n.event_id = nb.bk JOIN v1 ON v1.ak = b.event_id JOIN v2 ON v2.ak = b.event_id)""", select)


@query("smote_categories", _smote_mixed_sql("SELECT synthetic_id, step, amount, type, type2, isFraud FROM syn"))
def q_smote_categories(spark, d):
    t = features.pair_code(S.txn(spark, d)).select("event_id", "step", "amount", "type", "type2", S.LABEL)
    return round_doubles(balance.smote(t, S.LABEL, ["step", "amount", "type", "type2"], "event_id", k=5, seed=42,
                                       int_cols=["step"], categorical=["type", "type2"]))


_ONE_HOT_GROUPS = [[f"type_{v}" for v in S.TYPE_LABELS], [f"type2_{v}" for v in S.TYPE2_LABELS]]


@query("smote_one_hot_groups", _smote_mixed_sql(
    "SELECT synthetic_id, step, amount, " + ", ".join(f"CAST(type = '{v}' AS INTEGER) AS type_{v}" for v in S.TYPE_LABELS)
    + ", " + ", ".join(f"CAST(type2 = '{v}' AS INTEGER) AS type2_{v}" for v in S.TYPE2_LABELS) + ", isFraud FROM syn"))
def q_smote_one_hot_groups(spark, d):
    from .flow import prepared_features
    p = prepared_features(spark, d)
    return round_doubles(balance.smote(p, S.LABEL, S.FEATURES, "event_id", k=5, seed=42, int_cols=_INT_FEATS,
                                       categorical=_ONE_HOT_GROUPS))


# ======================================================================= S1-S5 (files)
from ..session import cut_lineage, scratch_dir  # noqa: E402
from ..sources import files  # noqa: E402

_TXN_TYPES = {"event_id": "bigint", "step": "int", "amount": "double", "oldbalanceOrg": "double",
              "newbalanceOrig": "double", "oldbalanceDest": "double", "newbalanceDest": "double",
              "isFraud": "int", "isFlaggedFraud": "int"}


def _txn_csv(spark, d) -> str:
    path = scratch_dir(spark, "txn-csv")
    files.write_csv(S.txn(spark, d), path)
    return path


@query("read_csv_roundtrip", with_(S.TXN_SQL, f"SELECT {TXN_COLS} FROM txn"))
def q_read_csv_roundtrip(spark, d):
    raw = files.read_transactions_csv(spark, _txn_csv(spark, d), typed=False, key="event_id")
    return features.cast_columns(raw, _TXN_TYPES)


@query("read_csv_permuted", with_(S.TXN_SQL, f"SELECT {TXN_COLS} FROM txn"))
def q_read_csv_permuted(spark, d):
    # the file has its columns in another order, and one more
    path = scratch_dir(spark, "txn-csv")
    t = S.txn(spark, d).withColumn("extra", F.lit("x"))
    files.write_csv(t.select(*reversed(t.columns)), path)
    return files.read_transactions_csv(spark, path, typed=True, key="event_id").drop(files.CORRUPT)


@query("read_csv_typed", with_(S.TXN_SQL, f"SELECT {TXN_COLS} FROM txn"))
def q_read_csv_typed(spark, d):
    typed = files.read_transactions_csv(spark, _txn_csv(spark, d), typed=True, key="event_id")
    return typed.drop(files.CORRUPT)


# lines of a file with every tenth line or so wrong in one of four ways, and some right ones
# with a quoted separator
_LINE_COLS = ["event_id", "step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest",
              "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud"]


def _line_text(text: str) -> str:
    """The line as SQL for both engines; ``text`` is the string type."""
    cell = {c: f"CAST({c} AS {text})" for c in _LINE_COLS}
    cell["step"] = f"CASE WHEN event_id % 79 = 0 THEN '12.5' ELSE {cell['step']} END"
    cell["amount"] = f"CASE WHEN event_id % 83 = 0 THEN 'abc' ELSE {cell['amount']} END"
    cell["nameOrig"] = f"CASE WHEN event_id % 73 = 0 THEN '\"C,1\"' ELSE nameOrig END"
    cell["isFlaggedFraud"] = "CASE WHEN event_id % 89 = 0 THEN '' ELSE '0' END"
    cells = ", ".join(f"{cell[c]}, ','" for c in _LINE_COLS[:-2])
    return (f"concat({cells}, {cell['isFraud']}, CASE WHEN event_id % 89 = 0 THEN '' ELSE ',0' END, "
            "CASE WHEN event_id % 97 = 0 AND event_id % 89 <> 0 THEN ',x' ELSE '' END)")


_BAD_LINE = ("(event_id % 79 = 0 OR event_id % 83 = 0 OR event_id % 89 = 0 OR event_id % 97 = 0)")


def _flawed_csv(spark, d) -> str:
    path = scratch_dir(spark, "txn-flawed")
    # one column named like the header, unquoted, so that each file has the header and the lines
    lines = S.txn(spark, d).select(F.expr(_line_text("STRING")).alias(",".join(_LINE_COLS)))
    (lines.write.option("header", True).option("sep", "\u0001").option("quote", "").option("escapeQuotes", False).csv(path))
    return path


@query("csv_checked_rows", with_(S.TXN_SQL, "SELECT " + TXN_COLS.replace(
    " nameOrig", " CASE WHEN event_id % 73 = 0 THEN 'C,1' ELSE nameOrig END AS nameOrig")
    + f" FROM txn WHERE NOT {_BAD_LINE}"))
def q_csv_checked_rows(spark, d):
    return files.read_transactions_csv_checked(spark, _flawed_csv(spark, d), key="event_id")[0]


@query("csv_quarantine", with_(S.TXN_SQL, f"""
SELECT {_line_text("VARCHAR")} AS line,
  CAST(12 + CASE WHEN event_id % 89 = 0 THEN -1 WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_fields,
  CASE WHEN event_id % 89 = 0 OR event_id % 97 = 0 THEN NULL WHEN event_id % 79 = 0 THEN 'step' ELSE 'amount' END AS failed_column,
  CASE WHEN event_id % 89 = 0 THEN 'too few fields' WHEN event_id % 97 = 0 THEN 'too many fields'
       WHEN event_id % 79 = 0 THEN 'not a value of type int' ELSE 'not a value of type double' END AS reason
FROM txn WHERE {_BAD_LINE}"""))
def q_csv_quarantine(spark, d):
    return files.read_transactions_csv_checked(spark, _flawed_csv(spark, d), key="event_id")[1].drop("file")


@query("convert_parquet", with_(S.TXN_SQL, f"SELECT {TXN_COLS} FROM txn"))
def q_convert_parquet(spark, d):
    raw = files.read_transactions_csv(spark, _txn_csv(spark, d), typed=False, key="event_id")
    path = files.convert_to_parquet(features.cast_columns(raw, _TXN_TYPES), scratch_dir(spark, "txn-parquet"))
    return files.read_table(spark, path)


@query("prepared_by_fold", with_(S.FEATURES_SQL, f"""
SELECT event_id, {', '.join(f if f != 'amount' else 'round(amount, 6) AS amount' for f in S.FEATURES)}, isFraud,
  CASE WHEN {_U_SQL.format(seed="'0'", key='event_id')} < 0.7 THEN 'train' ELSE 'test' END AS split,
  CAST(least(floor({_U_SQL.format(seed="'fold0'", key='event_id')} * 3), 2) AS INTEGER) AS fold
FROM feat"""))
def q_prepared_by_fold(spark, d):
    from .flow import prepared_features
    p = split.assign_folds(split.assign_split(prepared_features(spark, d), "event_id", 0.7, seed=0), "event_id", 3, seed=0)
    path = files.write_prepared(p, scratch_dir(spark, "prepared"), partition_by=["split", "fold"])
    return round_doubles(files.read_table(spark, path))


# ======================================================================= M
from . import models as M  # noqa: E402
from . import nodes  # noqa: E402
from . import tune as TU  # noqa: E402


def _train_test(spark, d):
    from .flow import prepared_features
    p = prepared_features(spark, d)
    return split.split(p, "event_id", 0.7, seed=0)


_NB_G = ", ".join(f"sum(CAST({f} AS DOUBLE)) AS s_{f}" for f in S.FEATURES)
_NB_S = " + ".join(f"s_{f}" for f in S.FEATURES)
_NB_SQL = S.FEATURES_SQL + f""",
g AS (SELECT CAST(isFraud AS DOUBLE) AS label, count(*) AS n, {_NB_G} FROM feat GROUP BY 1),
t AS (SELECT sum(n) AS n_all, count(*) AS n_cls FROM g),
nb AS (SELECT label, ln(n + 1.0) - ln(n_all + n_cls * 1.0) AS prior, """ + ", ".join(
    f"ln(s_{f} + 1.0) - ln({_NB_S} + {len(S.FEATURES)} * 1.0) AS th_{f}" for f in S.FEATURES) + " FROM g, t)"


@query("naive_bayes_stats", with_(_NB_SQL, " UNION ALL ".join(
    ["SELECT label, '(prior)' AS term, round(prior, 6) AS log_prob FROM nb"] +
    [f"SELECT label, '{f}' AS term, round(th_{f}, 6) AS log_prob FROM nb" for f in S.FEATURES])))
def q_naive_bayes_stats(spark, d):
    from .flow import prepared_features
    return round_doubles(M.naive_bayes_stats(prepared_features(spark, d), S.FEATURES, S.LABEL, 1.0))


def _nb_raw(c: str) -> str:
    return f"(SELECT prior + " + " + ".join(f"f.{f} * th_{f}" for f in S.FEATURES) + f" FROM nb WHERE label = {c})"


@query("naive_bayes_scores", with_(_NB_SQL, f"""
SELECT event_id, round(raw_0, 6) AS raw_0, round(raw_1, 6) AS raw_1,
       CASE WHEN raw_1 > raw_0 THEN 1.0 ELSE 0.0 END AS prediction
FROM (SELECT f.event_id, {_nb_raw('0.0')} AS raw_0, {_nb_raw('1.0')} AS raw_1 FROM feat f)"""))
def q_naive_bayes_scores(spark, d):
    from pyspark.ml.functions import vector_to_array
    from .flow import prepared_features
    p = prepared_features(spark, d)
    model = M.train_model("naive_bayes", p, S.FEATURES, S.LABEL, smoothing=1.0)
    s = M.score(model, p, S.LABEL, keep=["event_id"], flat=False)
    raw = vector_to_array("rawPrediction")
    return round_doubles(s.select("event_id", raw[0].alias("raw_0"), raw[1].alias("raw_1"), "prediction"))


def _scored(kind):
    def q(spark, d):
        train, test = _train_test(spark, d)
        model = M.train_model(kind, train, S.FEATURES, S.LABEL, seed=7)
        return M.score(model, test, S.LABEL, keep=["event_id"])
    return q


for _kind, _name in [("random_forest", "random_forest_score"), ("logistic_regression", "logistic_score"),
                     ("decision_tree", "decision_tree_score")]:
    query(_name, None)(_scored(_kind))


@query("naive_bayes_score", with_(_NB_SQL.replace("FROM feat GROUP BY 1", f"FROM feat WHERE {_U_SQL.format(seed=chr(39) + '0' + chr(39), key='event_id')} < 0.7 GROUP BY 1"), f"""
SELECT event_id, CAST(isFraud AS DOUBLE) AS label, CASE WHEN raw_1 > raw_0 THEN 1.0 ELSE 0.0 END AS prediction,
       round(1.0 / (1.0 + exp(raw_0 - raw_1)), 6) AS score
FROM (SELECT f.event_id, f.isFraud, {_nb_raw('0.0')} AS raw_0, {_nb_raw('1.0')} AS raw_1 FROM feat f
      WHERE {_U_SQL.format(seed="'0'", key='event_id')} >= 0.7)"""))
def q_naive_bayes_score(spark, d):
    return round_doubles(_scored("naive_bayes")(spark, d))


@query("tuned_importances", None)
def q_tuned_importances(spark, d):
    train, _ = _train_test(spark, d)
    model, _ = TU.tune("random_forest", train, S.FEATURES, S.LABEL, "event_id", seed=7)
    return M.feature_importances(model, S.FEATURES)


def _bayes_sql(train: str, scored: str, by: str, smoothings: list[float]) -> str:
    """CTEs: tp (by, label, sums of the training side of each ``by``), pr (with a smoothing a),
    sc (by, a, event_id, label, odds).  ``train`` gives (by, label, n, s_<feature>...),
    ``scored`` the rows with their ``by``."""
    fs, d = S.FEATURES, len(S.FEATURES)
    total = " + ".join(f"s_{f}" for f in fs)
    values = ", ".join(f"({float(a)!r}::DOUBLE)" for a in smoothings)
    theta = ", ".join(f"CASE WHEN s_{f} + a > 0 THEN ln(s_{f} + a) - ln({total} + {d} * a) END AS th_{f}" for f in fs)

    def terms(c: int) -> str:
        return f"p{c}.prior + " + " + ".join(f"CAST(r.{f} AS DOUBLE) * coalesce(p{c}.th_{f}, 0)" for f in fs)

    def blocked(c: int) -> str:
        return "(" + " OR ".join(f"(r.{f} > 0 AND p{c}.th_{f} IS NULL)" for f in fs) + ")"

    return f"""
tp AS ({train}),
av AS (SELECT * FROM (VALUES {values}) AS v(a)),
pr AS (SELECT {by}, label, a, ln(n + a) - ln(sum(n) OVER (PARTITION BY {by}, a) + 2 * a) AS prior, {theta} FROM tp, av),
sc AS (SELECT {by}, a, event_id, label,
         CASE WHEN b1 AND NOT b0 THEN '-Infinity'::DOUBLE WHEN b0 AND NOT b1 THEN 'Infinity'::DOUBLE ELSE m1 - m0 END AS odds
       FROM (SELECT r.{by}, p0.a, r.event_id, r.isFraud AS label, {terms(0)} AS m0, {terms(1)} AS m1,
                    {blocked(0)} AS b0, {blocked(1)} AS b1
             FROM ({scored}) r JOIN pr p0 ON p0.{by} = r.{by} AND p0.label = 0
             JOIN pr p1 ON p1.{by} = r.{by} AND p1.label = 1 AND p1.a = p0.a))"""


def _fold_auc_sql(folds: int) -> str:
    """(a, fold, auc_roc) as CTE fa: every training side's sums are recomputed from its rows."""
    u = _U_SQL.format(seed="'fold0'", key="event_id")
    sums = ", ".join(f"sum(CAST({f} AS DOUBLE)) AS s_{f}" for f in S.FEATURES)
    train = f"""SELECT k.fold, isFraud AS label, count(*) AS n, {sums}
  FROM ff JOIN (SELECT unnest(range({folds})) AS fold) k ON ff.fold <> k.fold GROUP BY ALL"""
    return with_(S.FEATURES_SQL + f""",
ff AS (SELECT *, least(floor({u} * {folds}), {folds - 1}) AS fold FROM feat),""" + _bayes_sql(
        train, "SELECT * FROM ff", "fold", TU.GRIDS["naive_bayes"]["smoothing"]) + """,
fa AS (SELECT a, fold, (s - P * (P + 1) / 2.0) / (P * N) AS auc_roc FROM (
   SELECT a, fold, sum(CASE WHEN label = 1 THEN rk + (c - 1) / 2.0 END) AS s,
          sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS P, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS N
   FROM (SELECT a, fold, label, rank() OVER (PARTITION BY a, fold ORDER BY odds) AS rk,
                count(*) OVER (PARTITION BY a, fold, odds) AS c FROM sc) GROUP BY a, fold))""", "")


def _fold_metrics(folds):
    def q(spark, d):
        from .flow import prepared_features
        return round_doubles(TU.fold_metrics("naive_bayes", prepared_features(spark, d), S.FEATURES, S.LABEL, "event_id",
                                             folds=folds))
    return q


for _folds in (2, 5):
    query(f"tune_nb_{_folds}_folds", _fold_auc_sql(_folds) + """
SELECT concat('smoothing=', CAST(a AS VARCHAR)) AS params, CAST(fold AS INTEGER) AS fold, round(auc_roc, 6) AS auc_roc
FROM fa""")(_fold_metrics(_folds))


@query("tune_nb", _fold_auc_sql(3) + """
SELECT concat('smoothing=', CAST(a AS VARCHAR)) AS params, round(avg(auc_roc), 6) AS auc_roc FROM fa GROUP BY a""")
def q_tune_nb(spark, d):
    from .flow import prepared_features
    _, table = TU.tune("naive_bayes", prepared_features(spark, d), S.FEATURES, S.LABEL, "event_id", folds=3)
    return round_doubles(table)


def _tuned(kind):
    def q(spark, d):
        from .flow import prepared_features
        _, table = TU.tune(kind, prepared_features(spark, d), S.FEATURES, S.LABEL, "event_id", folds=3)
        return table
    return q


for _kind, _name in [("decision_tree", "tune_dt"), ("logistic_regression", "tune_lr"), ("random_forest", "tune_rf")]:
    query(_name, None)(_tuned(_kind))


@query("best_params", None)
def q_best_params(spark, d):
    from .flow import prepared_features
    model, _ = TU.tune("decision_tree", prepared_features(spark, d), S.FEATURES, S.LABEL, "event_id")
    return TU.best_params(model)


def _sweep(kind):
    def q(spark, d):
        train, test = _train_test(spark, d)
        return TU.sweep(kind, train, test, S.FEATURES, S.LABEL)
    return q


for _kind, _name in [("decision_tree", "sweep_depth"), ("random_forest", "sweep_forest_depth"),
                     ("logistic_regression", "sweep_elastic_net")]:
    query(_name, None)(_sweep(_kind))


@query("sweep_smoothing", with_(S.FEATURES_SQL + f""",
fs AS (SELECT *, {_U_SQL.format(seed="'0'", key='event_id')} < 0.7 AS is_train, 1 AS one FROM feat),""" + _bayes_sql(
    "SELECT one, isFraud AS label, count(*) AS n, " + ", ".join(f"sum(CAST({f} AS DOUBLE)) AS s_{f}" for f in S.FEATURES)
    + " FROM fs WHERE is_train GROUP BY ALL", "SELECT * FROM fs", "one", TU.SWEEPS["naive_bayes"][1]), """
SELECT a AS value, round(avg(CASE WHEN is_train THEN ok END), 6) AS train_accuracy,
       round(avg(CASE WHEN NOT is_train THEN ok END), 6) AS test_accuracy
FROM (SELECT a, is_train, CASE WHEN (odds > 0) = (label = 1) THEN 1.0 ELSE 0.0 END AS ok
      FROM sc JOIN fs USING (event_id)) GROUP BY a"""))
def q_sweep_smoothing(spark, d):
    return round_doubles(_sweep("naive_bayes")(spark, d))


@query("feature_importances", None)
def q_feature_importances(spark, d):
    train, _ = _train_test(spark, d)
    return M.feature_importances(M.train_model("random_forest", train, S.FEATURES, S.LABEL, seed=7), S.FEATURES)


@query("coefficients", None)
def q_coefficients(spark, d):
    train, _ = _train_test(spark, d)
    return M.coefficients(M.train_model("logistic_regression", train, S.FEATURES, S.LABEL), S.FEATURES)


@query("objective_history", None)
def q_objective_history(spark, d):
    train, _ = _train_test(spark, d)
    return M.objective_history(M.train_model("logistic_regression", train, S.FEATURES, S.LABEL))


@query("explain_params", None)
def q_explain_params(spark, d):
    # the values are those that tuning found best on the rows
    from .flow import prepared_features
    model, _ = TU.tune("decision_tree", prepared_features(spark, d), S.FEATURES, S.LABEL, "event_id")
    return M.explain_params(model)


_KINDS_TUNED = [*M.KINDS, "tuned_tree"]
_SCORED = ["features", "rawPrediction", "probability"]


@query("model_roundtrip", with_(S.TXN_SQL, f"""
SELECT k.kind, n, n AS n_equal FROM (SELECT unnest({_KINDS_TUNED}) AS kind) k,
  (SELECT count(*) AS n FROM txn WHERE {_U_SQL.format(seed="'0'", key='event_id')} >= 0.7)"""))
def q_model_roundtrip(spark, d):
    from ..sources.models import load_model, save_model
    train, test = (cut_lineage(side, "side") for side in _train_test(spark, d))
    models = []
    for kind in _KINDS_TUNED:
        if kind == "tuned_tree":
            model, _ = TU.tune("decision_tree", train, S.FEATURES, S.LABEL, "event_id", seed=7)
        else:
            model = M.train_model(kind, train, S.FEATURES, S.LABEL, seed=7)
        path = save_model(model, scratch_dir(spark, f"model-{kind}"))
        models.append((kind, model, load_model(path, spark)))
    # all kinds' predictions side by side: one join of the fitted models' rows with the loaded ones'
    a, b = test, test
    for i, (_, model, again) in enumerate(models):
        a = M.score(model, a, S.LABEL, flat=False).withColumnRenamed("prediction", f"p{i}").drop(*_SCORED)
        b = M.score(again, b, S.LABEL, flat=False).withColumnRenamed("prediction", f"q{i}").drop(*_SCORED)
    both = a.select("event_id", *[f"p{i}" for i in range(len(models))]).join(
        b.select("event_id", *[f"q{i}" for i in range(len(models))]), "event_id")
    row = both.agg(F.count(F.lit(1)).alias("n"), *[
        F.sum((F.col(f"p{i}") == F.col(f"q{i}")).cast("int")).cast("bigint").alias(f"e{i}") for i in range(len(models))])
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col("n").alias("n"), F.col(f"e{i}").alias("n_equal"))
                      for i, (kind, _, _) in enumerate(models)])
    return row.select(F.explode(kinds).alias("e")).select("e.*")


@query("scored_in_order", with_(_NB_SQL, f"""
SELECT event_id, prediction, row_number() OVER (ORDER BY prediction, event_id) AS place
FROM (SELECT f.event_id, CASE WHEN {_nb_raw('1.0')} > {_nb_raw('0.0')} THEN 1.0 ELSE 0.0 END AS prediction FROM feat f)"""))
def q_scored_in_order(spark, d):
    """The scored table sorted by prediction, with each row's place."""
    from ..functions.prefix import global_rank
    from .flow import prepared_features
    p = prepared_features(spark, d)
    s = M.score(M.train_model("naive_bayes", p, S.FEATURES, S.LABEL, smoothing=1.0), p, S.LABEL, keep=["event_id"])
    ranked = global_rank(cut_lineage(s.select("event_id", "prediction"), "scored"), ["prediction", "event_id"], "place")
    return ranked.orderBy("place")


_TABLED = ["decision_tree", "logistic_regression", "random_forest"]


@query("model_table_scores", with_(S.TXN_SQL, f"""
SELECT k.kind, n, n AS n_equal FROM (SELECT unnest({_TABLED}) AS kind) k,
  (SELECT count(*) AS n FROM txn WHERE {_U_SQL.format(seed="'0'", key='event_id')} >= 0.7)"""))
def q_model_table_scores(spark, d):
    """Scores computed from the models' tables against those of the models."""
    train, test = (cut_lineage(side, "side") for side in _train_test(spark, d))
    outs = None
    for kind in _TABLED:
        model = M.train_model(kind, train, S.FEATURES, S.LABEL, seed=7)
        if kind == "logistic_regression":
            own = nodes.score_linear(test, M.coefficients(model, S.FEATURES), S.LABEL, keep=["event_id"])
        else:
            own = nodes.score_nodes(test, nodes.node_table(model, S.FEATURES), S.FEATURES, S.LABEL, keep=["event_id"])
        own = own.select("event_id", F.col("prediction").alias("p"), F.col("score").alias("s"))
        both = M.score(model, test, S.LABEL, keep=["event_id"]).join(own, "event_id")
        same = (F.col("p") == F.col("prediction")) & (F.abs(F.col("s") - F.col("score")) < 1e-9)
        row = both.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_equal"))
        outs = row if outs is None else outs.unionByName(row)
    return outs


# ======================================================================= A9 A10
from ..operators import profile, sketches  # noqa: E402


@query("kde_amount", with_(S.TXN_SQL, """,
s AS (SELECT min(amount) AS lo, max(amount) AS hi, count(amount) AS n, stddev_samp(amount) AS sd FROM txn),
p AS (SELECT lo, n, sd * pow(n, -0.2) AS bw, (hi - lo) / 2048 AS w, (hi - lo) / 199 AS step FROM s),
b AS (SELECT least(floor((amount - lo) / w), 2047) AS b, count(*) AS c FROM txn, p
      WHERE amount IS NOT NULL GROUP BY 1),
bc AS (SELECT lo + (b + 0.5) * w AS center, c FROM b, p)
SELECT CAST(r.g AS INTEGER) AS g, round(lo + r.g * step, 6) AS x,
       round(sum(c * exp(-0.5 * (((lo + r.g * step) - center) / bw) * (((lo + r.g * step) - center) / bw)))
             * (1.0 / (n * bw * sqrt(2 * pi()))), 10) AS density
FROM bc, p, (SELECT range AS g FROM range(200)) r
GROUP BY r.g, lo, step, n, bw""".lstrip(",")).replace("WITH txn AS", "WITH txn AS", 1)
       .replace("FROM events)\n", "FROM events),\n", 1).replace("FROM events),\n\ns AS", "FROM events),\ns AS"))
def q_kde_amount(spark, d):
    k = explore.kde(S.txn(spark, d), "amount", grid=200, fine_bins=2048)
    return k.select(F.col("g").cast("int").alias("g"), rnd(F.col("x"), 6).alias("x"),
                    rnd(F.col("density"), 10).alias("density"))


_AUTO_K = """
s0 AS (SELECT min(amount) AS lo, max(amount) AS hi, count(amount) AS n,
              quantile_cont(amount, 0.75) - quantile_cont(amount, 0.25) AS iqr FROM txn),
k AS (SELECT CAST(ceil((hi - lo) / CASE WHEN 2.0 * iqr * pow(n, -1.0 / 3.0) > 0
        THEN least(2.0 * iqr * pow(n, -1.0 / 3.0), (hi - lo) / (log2(n) + 1.0))
        ELSE (hi - lo) / (log2(n) + 1.0) END) AS INTEGER) AS nb FROM s0)"""


@query("histogram_auto", with_(S.TXN_SQL + "," + _AUTO_K,
                               _hist_sql_nocol("txn", "amount", "(SELECT nb FROM k)")))
def q_histogram_auto(spark, d):
    return round_doubles(explore.histogram(S.txn(spark, d), "amount", "auto"))


def _pnum_sql(src: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for c, t in cols:
        parts.append(f"""
SELECT '{c}' AS column_name, '{t}' AS data_type, count(x) AS n, count(*) - count(x) AS n_missing,
  count(DISTINCT x) AS n_distinct, CAST(sum(CASE WHEN x = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zeros,
  CAST(sum(CASE WHEN x < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative,
  min(x) AS min, max(x) AS max, avg(x) AS mean, stddev_samp(x) AS std, var_samp(x) AS variance,
  CASE WHEN count(x) > 2 THEN skewness(x) END AS skewness, CASE WHEN count(x) > 3 THEN kurtosis(x) END AS kurtosis,
  sum(x) AS sum
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {src})""")
    return " UNION ALL ".join(parts)


_TEN_DIGITS = ["min", "max", "mean", "std", "variance", "sum"]


def _pnum_round(inner: str) -> str:
    """Sums and moments to ten significant digits: double sums depend on the order of
    the additions in their last digits."""
    return f"""SELECT column_name, data_type, n, n_missing, n_distinct, n_zeros, n_negative,
  {', '.join(f"CAST(printf('%.9e', {c}) AS DOUBLE) AS {c}" for c in _TEN_DIGITS)},
  round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis FROM ({inner})"""


def _pnum_spark(df):
    out = profile.profile_numeric(df)
    for c in _TEN_DIGITS:
        out = out.withColumn(c, F.format_string("%.9e", F.col(c).cast("double")).cast("double"))
    return out.withColumns({c: rnd(F.col(c), 6) for c in ("skewness", "kurtosis")})


_DIRTY_NUM = [("step", "int"), ("amount", "double"), ("isFraud", "int")]


@query("profile_numeric", with_(S.TXN_DIRTY_SQL, _pnum_round(_pnum_sql("txn_dirty", _DIRTY_NUM))))
def q_profile_numeric(spark, d):
    return _pnum_spark(S.txn_dirty(spark, d).select("step", "amount", "isFraud"))


@query("profile_numeric_customer", _pnum_round(_pnum_sql("customer", [("c_nationkey", "int"),
                                                                      ("c_acctbal", "double")])))
def q_profile_numeric_customer(spark, d):
    return _pnum_spark(S.table(spark, d, "customer").select("c_nationkey", "c_acctbal"))


@query("profile_numeric_lineitem", _pnum_round(_pnum_sql("lineitem", [(c, "double") for c in _LI_NUM])))
def q_profile_numeric_lineitem(spark, d):
    return _pnum_spark(S.table(spark, d, "lineitem").select(*_LI_NUM))


@query("profile_quantiles", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, round(quantile_cont({c}, 0.05), 6) AS p5, round(quantile_cont({c}, 0.25), 6) AS p25,
  round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
  round(quantile_cont({c}, 0.95), 6) AS p95, round(max({c}) - min({c}), 6) AS range,
  round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr FROM lineitem""" for c in _LI_NUM))
def q_profile_quantiles(spark, d):
    return round_doubles(profile.profile_quantiles(S.table(spark, d, "lineitem"), _LI_NUM))


_DIRTY_STR = ["type", "nameOrig", "nameDest"]


def _pcat_sql(src: str, cols: list[str], digits: int = 6) -> str:
    return " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count({c}) AS n, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct,
  CAST(min(length({c})) AS INTEGER) AS min_length, round(avg(length({c})), {digits}) AS mean_length,
  CAST(max(length({c})) AS INTEGER) AS max_length FROM {src}""" for c in cols)


@query("profile_categorical", with_(S.TXN_DIRTY_SQL, _pcat_sql("txn_dirty", _DIRTY_STR)))
def q_profile_categorical(spark, d):
    return round_doubles(profile.profile_categorical(S.txn_dirty(spark, d), _DIRTY_STR))


def _top_sql(src: str, cols: list[str], k: int) -> str:
    inner = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {src} "
        f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols)
    return f"""SELECT column_name, value, count, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rank FROM ({inner}))
WHERE rank <= {k}"""


@query("profile_top_values", with_(S.TXN_DIRTY_SQL, _top_sql("txn_dirty", ["type", "nameDest"], 5)))
def q_profile_top_values(spark, d):
    return profile.top_values(S.txn_dirty(spark, d), ["type", "nameDest"], k=5)


@query("profile_top_values_customer", _top_sql("customer", ["c_mktsegment", "c_nationkey"], 3))
def q_profile_top_values_customer(spark, d):
    return profile.top_values(S.table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], k=3)


@query("profile_missing", with_(S.TXN_DIRTY_SQL, " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, "
    f"round((count(*) - count({c})) / count(*), 6) AS pct_missing FROM txn_dirty"
    for c in TXN_COLS.split(", "))))
def q_profile_missing(spark, d):
    return round_doubles(profile.profile_missing(S.txn_dirty(spark, d)))


_SKETCHED = ["type", "nameOrig", "nameDest"]


@query("top_values_sketched", with_(S.TXN_DIRTY_SQL, _top_sql("txn_dirty", _SKETCHED, 5)))
def q_top_values_sketched(spark, d):
    # few values of nameOrig and nameDest stand out: these columns are counted in full
    return sketches.top_values_sketched(S.txn_dirty(spark, d), _SKETCHED, k=5, tracked=512)


@query("sketch_profile_merged", _pnum_round(_pnum_sql("lineitem", [(c, "double") for c in _LI_NUM])).replace(
    "SELECT column_name, data_type, n, n_missing, n_distinct,", "SELECT column_name, n, n_missing,"))
def q_sketch_profile_merged(spark, d):
    """The exact part of a profile merged from the sketches of seven parts of the rows."""
    li = S.table(spark, d, "lineitem").withColumn("part", F.col("l_orderkey") % 7)
    parts = cut_lineage(sketches.column_sketches(li, _LI_NUM, [], by=["part"]), "column-sketches")
    out = sketches.sketch_statistics(sketches.merge_sketches(parts))
    for c in _TEN_DIGITS:
        out = out.withColumn(c, F.format_string("%.9e", F.col(c)).cast("double"))
    out = out.withColumns({c: rnd(F.col(c), 6) for c in ("skewness", "kurtosis")})
    return out.select("column_name", "n", "n_missing", "n_zeros", "n_negative", *_TEN_DIGITS, "skewness", "kurtosis")


_SMALL_NUM, _SMALL_STR = [("step", "int"), ("amount", "double"), ("isFraud", "int")], ["type", "nameDest"]


def _alerts_sql(nums: list[tuple[str, str]] = _SMALL_NUM, strs: list[str] = _SMALL_STR) -> str:
    num, cat, top1 = _pnum_sql("txn_dirty", nums), _pcat_sql("txn_dirty", strs), _top_sql("txn_dirty", strs, 1)
    every = ", ".join([c for c, _ in nums] + strs)
    return with_(S.TXN_DIRTY_SQL + f""",
pn AS ({num}), pc AS ({cat}), t1 AS ({top1}),
dup AS (SELECT CAST(sum(c - 1) AS BIGINT) AS nd FROM (
  SELECT {every}, count(*) AS c FROM txn_dirty GROUP BY ALL))""", """
SELECT column_name, 'CONSTANT' AS alert, 1.0 AS value FROM pn WHERE n_distinct = 1
UNION ALL SELECT column_name, 'MISSING', round(n_missing / (n + n_missing), 6) FROM pn WHERE n_missing > 0
UNION ALL SELECT column_name, 'SKEWED', round(skewness, 6) FROM pn WHERE abs(skewness) > 20.0
UNION ALL SELECT column_name, 'ZEROS', round(n_zeros / n, 6) FROM pn WHERE n_zeros / n > 0.1
UNION ALL SELECT column_name, 'CONSTANT', 1.0 FROM pc WHERE n_distinct = 1
UNION ALL SELECT column_name, 'MISSING', round(n_missing / (n + n_missing), 6) FROM pc WHERE n_missing > 0
UNION ALL SELECT t1.column_name, 'IMBALANCE', round(t1.count / pc.n, 6) FROM t1 JOIN pc USING (column_name)
          WHERE t1.count / pc.n > 0.5
UNION ALL SELECT '(table)', 'DUPLICATES', CAST(nd AS DOUBLE) FROM dup WHERE nd > 0""")


@query("profile_alerts", _alerts_sql())
def q_profile_alerts(spark, d):
    t = S.txn_dirty(spark, d).select("step", "type", "amount", "isFraud", "nameDest")
    return round_doubles(profile.profile_alerts(t, ["step", "amount", "isFraud"], ["type", "nameDest"]))


_FULL_NUM = [(c, "double" if "alance" in c or c == "amount" else "bigint" if c == "event_id" else "int")
             for c in TXN_COLS.split(", ") if c not in ("type", "nameOrig", "nameDest")]
_FULL_STR = ["type", "nameOrig", "nameDest"]


def _profile_sql(ctes: str, src: str, nums: list[tuple[str, str]], strs: list[str], columns: list[str]) -> str:
    """Every section of the profile of ``src`` in long form, six significant digits.  Top
    values of numbers are compared as numbers."""
    names = [c for c, _ in nums]
    parts = [f"SELECT 'numeric' AS section, column_name, '{c}' AS item, CAST({c} AS DOUBLE) AS value FROM pn"
             for c in ("n", "n_missing", "n_distinct", "n_zeros", "n_negative", "min", "max", "mean", "std", "variance",
                       "skewness", "kurtosis", "sum")]
    for c in names:
        parts += [f"SELECT 'quantiles', '{c}', 'p{p}', CAST(quantile_cont({c}, {p / 100}) AS DOUBLE) FROM {src}"
                  for p in (5, 25, 50, 75, 95)]
        parts += [f"SELECT 'quantiles', '{c}', 'range', CAST(max({c}) - min({c}) AS DOUBLE) FROM {src}",
                  f"SELECT 'quantiles', '{c}', 'iqr', CAST(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS DOUBLE) FROM {src}"]
        parts += [f"SELECT 'correlation', '{c}', '{x}', corr({c}, {x}) FROM {src}" for x in names]
    for c in columns:
        parts += [f"SELECT 'missing', '{c}', 'n_missing', CAST(count(*) - count({c}) AS DOUBLE) FROM {src}",
                  f"SELECT 'missing', '{c}', 'pct_missing', (count(*) - count({c})) / count(*) FROM {src}"]
    parts.append("SELECT 'top_values', column_name, concat(rank, ':', printf('%.5e', CAST(value AS DOUBLE))), "
                 "CAST(count AS DOUBLE) FROM tn")
    alerts = """
SELECT column_name, 'CONSTANT' AS alert, 1.0 AS value FROM pn WHERE n_distinct = 1
UNION ALL SELECT column_name, 'MISSING', n_missing / (n + n_missing) FROM pn WHERE n_missing > 0
UNION ALL SELECT column_name, 'SKEWED', skewness FROM pn WHERE abs(skewness) > 20.0 AND NOT isnan(skewness)
UNION ALL SELECT column_name, 'ZEROS', n_zeros / n FROM pn WHERE n_zeros / n > 0.1
UNION ALL SELECT '(table)', 'DUPLICATES', CAST(nd AS DOUBLE) FROM dup WHERE nd > 0"""
    strings = ""
    if strs:
        parts += [f"SELECT 'categorical', column_name, '{c}', CAST({c} AS DOUBLE) FROM pc"
                  for c in ("n", "n_missing", "n_distinct", "min_length", "mean_length", "max_length")]
        parts.append("SELECT 'top_values', column_name, concat(rank, ':', value), CAST(count AS DOUBLE) FROM tv")
        strings = f""",
pc AS ({_pcat_sql(src, strs, 15)}), tv AS ({_top_sql(src, strs, 5)}), t1 AS ({_top_sql(src, strs, 1)})"""
        alerts += """
UNION ALL SELECT column_name, 'CONSTANT', 1.0 FROM pc WHERE n_distinct = 1
UNION ALL SELECT column_name, 'MISSING', n_missing / (n + n_missing) FROM pc WHERE n_missing > 0
UNION ALL SELECT t1.column_name, 'IMBALANCE', t1.count / pc.n FROM t1 JOIN pc USING (column_name) WHERE t1.count / pc.n > 0.5"""
    parts.append(f"SELECT 'alerts', column_name, alert, value FROM ({alerts})")
    return with_(ctes + f""",
pn AS ({_pnum_sql(src, nums)}), tn AS ({_top_sql(src, names, 5)}),
dup AS (SELECT CAST(sum(c - 1) AS BIGINT) AS nd FROM (SELECT {', '.join(columns)}, count(*) AS c FROM {src} GROUP BY ALL)){strings},
every_row AS ({" UNION ALL ".join(parts)})""", """
SELECT section, column_name, item,
       CASE WHEN abs(value) < 1e-7 THEN 0.0
            WHEN value IS NOT NULL AND NOT isnan(value) THEN CAST(printf('%.5e', value * 1.000000001) AS DOUBLE) END AS value FROM every_row""")


def _profile_rows(df: DataFrame) -> DataFrame:
    """``profile_long`` with six significant digits and top values of numbers as numbers."""
    numbers = profile.numeric_columns(df)
    rows = profile.profile_long(df)
    top = (F.col("section") == "top_values") & F.col("column_name").isin(numbers)
    rank = F.split("item", ":")
    item = F.when(top, F.concat(rank[0], F.lit(":"), F.format_string("%.5e", rank[1].cast("double")))).otherwise(F.col("item"))
    # below 1e-7 stands what rounding leaves of zero; the factor makes no value a tie of its last digit
    value = F.when(F.abs("value") < 1e-7, 0.0).when(
        F.col("value").isNotNull() & ~F.isnan("value"), F.format_string("%.5e", F.col("value") * 1.000000001).cast("double"))
    return rows.withColumn("item", item).withColumn("value", value)


@query("profile_full", _profile_sql(S.TXN_DIRTY_SQL, "txn_dirty", _FULL_NUM, _FULL_STR, TXN_COLS.split(", ")))
def q_profile_full(spark, d):
    return _profile_rows(S.txn_dirty(spark, d))


@query("profile_balanced", _profile_sql(
    S.FEATURES_SQL + "," + _round_sql("feat", "a_", 42, _INT_FEATS), "a_out",
    [(c, "double" if c == "amount" else "int") for c in [*S.FEATURES, "isFraud"]], [], [*S.FEATURES, "isFraud"]))
def q_profile_balanced(spark, d):
    from .flow import prepared_features
    p = prepared_features(spark, d)
    b = balance.balance(p, S.LABEL, S.FEATURES, "event_id", int_cols=_INT_FEATS)
    return _profile_rows(b.drop("event_id"))


# ======================================================================= whole job
@query("prepare_split_balance", with_(S.FEATURES_SQL + f""",
fd AS ({_deduped_sql("feat", [*S.FEATURES, "isFraud"])}),
fu AS (SELECT *, {_U_SQL.format(seed="'0'", key='event_id')} < 0.7 AS is_train FROM fd),
tr AS (SELECT event_id, {', '.join(S.FEATURES)}, isFraud FROM fu WHERE is_train),""" + _round_sql("tr", "a_", 42, _INT_FEATS), f"""
SELECT {_BALANCED_COLS}, 'train' AS part FROM a_out
UNION ALL SELECT {_BALANCED_COLS}, 'test' AS part FROM fu WHERE NOT is_train"""))
def q_prepare_split_balance(spark, d):
    from .flow import prepare_for_training
    train, test = prepare_for_training(S.txn(spark, d))
    return round_doubles(train.withColumn("part", F.lit("train"))
                         .unionByName(test.withColumn("part", F.lit("test"))))


@query("run_all", None)
def q_run_all(spark, d):
    from .flow import run_all
    return round_doubles(run_all(spark, d))
