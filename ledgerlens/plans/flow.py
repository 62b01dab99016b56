"""End-to-end plans: prepare the transaction table as the reference's
model input (SURVEY §3.1), as one chain of lazy DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import clean, features


def prepare(df: DataFrame, key: str | None = S.KEY, categories: dict | None = None,
            dedupe: bool = True) -> DataFrame:
    """raw transactions -> pair code -> dummies -> drop ids/balances -> drop
    nulls -> drop duplicates (keeping the smallest key) -> model-input columns.

    The dummy labels are fitted on ``df`` with one aggregate per column;
    ``categories`` fixes them instead, and a label outside them raises."""
    t = features.pair_code(df)
    t = features.get_dummies(t, ["type", "type2"], categories=categories)
    t = features.drop_columns(t, S.ID_COLUMNS + S.BALANCE_COLUMNS)
    lead = ([key] if key else []) + ["step", "amount"]
    dummies = [c for c in t.columns if c.startswith(("type_", "type2_"))]
    t = t.select(*lead, *dummies, S.LABEL)
    t = clean.drop_nulls(t)
    if dedupe:
        t = clean.drop_duplicates(t, keep_by=key)
    return t


def feature_columns(prepared: DataFrame, key: str | None = S.KEY) -> list[str]:
    """The model inputs of a prepared table: all but key and label."""
    return [c for c in prepared.columns if c not in (key, S.LABEL)]


def prepared_features(spark: SparkSession, sf_dir: str, dedupe: bool = False) -> DataFrame:
    """The model-input table made from the ``txn`` fixture (no dedupe by default,
    so every row keeps its ``event_id``)."""
    return prepare(S.txn(spark, sf_dir), dedupe=dedupe)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fraud / non-fraud rows per transaction type after cleaning."""
    t = S.txn(spark, sf_dir)
    p = prepare(t)
    labels = [c.removeprefix("type_") for c in p.columns if c.startswith("type_")]
    types = F.coalesce(*[F.when(F.col(f"type_{lab}") == 1, F.lit(lab)) for lab in labels])
    return (p.withColumn("type", types)
            .groupBy("type", S.LABEL).agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.round(F.sum("amount"), 2).alias("total_amount")))


def prepare_for_training(df: DataFrame, key: str = S.KEY, fraction: float = 0.7, seed: int = 0,
                         rounds: int = 1, balance_first: bool = False):
    """(train, test): split first and balance the training side only; with
    ``balance_first`` the reference's order (balance, then split) is reproduced."""
    from ..operators import balance, split
    p = prepare(df, key=key)
    names = feature_columns(p, key)
    int_cols = [f for f in names if f != "amount"]
    if balance_first:
        b = balance.balance(p, S.LABEL, names, key, rounds=rounds, int_cols=int_cols)
        return split.split(b, key, fraction, seed)
    train, test = split.split(p, key, fraction, seed)
    return balance.balance(train, S.LABEL, names, key, rounds=rounds, int_cols=int_cols), test


def run_all(spark: SparkSession, sf_dir: str, kinds=None, max_gap: float | None = 0.05,
            seed: int = 7) -> DataFrame:
    """The reference's whole job, as intended: prepare -> split -> balance the
    training side -> train each kind -> score -> compare (accuracy, precision,
    recall, AUC on probabilities, train-test gap) -> the selected model first."""
    from ..operators import choose
    from . import models as M
    kinds = list(kinds or M.KINDS)
    train, test = prepare_for_training(S.txn(spark, sf_dir))
    from ..session import cut_lineage
    train, test = cut_lineage(train, "train"), cut_lineage(test, "test")
    names = feature_columns(train)
    rows = None
    for kind in kinds:
        model = M.train_model(kind, train, names, S.LABEL, seed=seed)
        test_m = choose.model_metrics(kind, M.score(model, test, S.LABEL))
        train_acc = M.score(model, train, S.LABEL).agg(
            F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        r = test_m.withColumn("train_accuracy", F.lit(train_acc).cast("double"))
        rows = r if rows is None else rows.unionByName(r)
    # one row per model, written once: the selection below and the caller read
    # the file instead of scoring every model again
    rows = cut_lineage(rows.withColumn("gap", F.col("train_accuracy") - F.col("accuracy")), "run-all")
    best = choose.select_model(rows, "auc_roc", "gap", max_gap).select("name_model").first()
    if best is None:
        best = choose.select_model(rows, "auc_roc").select("name_model").first()
    return rows.withColumn("selected", F.col("name_model") == F.lit(best["name_model"]))
