"""Every registered query against its DuckDB oracle, compared as the driver does
(columns by name, rows order-insensitive). Runs on the smallest fixture."""

import pytest

import __spark_entry__ as entry
from sparkqa import catalog, oracles
from compare import compare, duck
from conftest import SF_SMALL

ORACLES = oracles.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows, d_cols, d_rows = compare(df, con, ORACLES[name])
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


def test_every_query_registered_once():
    assert len(catalog.QUERIES) == 68
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["qid", "question", "model_response", "answer"]
