"""Registered queries: against their SQL over whole tables, or for rows and schema."""

import duckdb
import pytest

from ledgerlens.llm import queries
from oracle import compare, duck

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert not compare(queries.QUERIES[name](spark, SMALL), duck(SMALL), queries.ORACLES[name])


# these return pieces and words; their own tests hold them against plain versions
OTHER_ROWS = {"op12_packing", "op13_spelling_variants"}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - OTHER_ROWS))
def test_whole_table(spark, name):
    table = "pages" if name == "op6_html_text" else "documents"
    n = duckdb.sql(f"SELECT count(*) FROM '{SMALL}/{table}.parquet'").fetchall()[0][0]
    assert queries.QUERIES[name](spark, SMALL).count() == n


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
