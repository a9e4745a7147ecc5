"""Every registered query against its DuckDB oracle at sf0.01 (the driver's
correctness gate, run locally)."""
from __future__ import annotations

import pytest

import __spark_entry__ as entry_mod
from opslens.plans.registry import QUERIES as REPORT_QUERIES
from tests.conftest import SF_CHECK
from tests.parity import compare, duck

QUERIES = entry_mod.queries()
ORACLE = entry_mod.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


def test_every_query_has_an_oracle():
    # the queries of opslens.llm say themselves which of them SQL can express
    assert set(ORACLE) <= set(QUERIES)
    assert set(REPORT_QUERIES) <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(REPORT_QUERIES))
def test_matches_oracle(spark, con, name):
    r = compare(spark, con, SF_CHECK, name, QUERIES[name], ORACLE[name])
    assert r["columns_ok"], r["columns"]
    assert r["rows_spark"] == r["rows_duck"]
    assert r["rows_spark"] > 0
    assert r["values_ok"], r["diff"]


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["usage_date", "sku_name", "dbu", "est_usd"]
