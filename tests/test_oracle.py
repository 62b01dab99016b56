"""Every registered query against its DuckDB oracle at sf0.01 (rows-only
queries: they run and give rows with a stable schema)."""

import pytest

import __spark_entry__ as E
from conftest import SF_ORACLE
from ledgerlens.plans import catalog
from oracle import compare, duck

QUERIES = {k: f for k, f in E.queries().items() if k in catalog.QUERIES}
ORACLES = {k: s for k, s in E.oracle_sql().items() if k in catalog.QUERIES}


# rows that a query without SQL must have
ROWS = {"tune_nb": 3, "tune_dt": 2, "tune_lr": 9, "tune_rf": 9, "tune_nb_2_folds": 6, "tune_nb_5_folds": 15, "best_params": 1,
        "sweep_depth": 15, "sweep_smoothing": 11, "sweep_forest_depth": 11, "sweep_elastic_net": 11,
        "feature_importances": 9, "tuned_importances": 9, "coefficients": 10, "run_all": 4}


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_ORACLE)
    problems = compare(df, con, ORACLES[name])
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, SF_ORACLE)
    schema1 = df.schema.simpleString()
    assert df.count() == ROWS.get(name, df.count()) > 0
    assert QUERIES[name](spark, SF_ORACLE).schema.simpleString() == schema1


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"type", "isFraud", "n_rows", "total_amount"}
