"""Every registered query against its DuckDB twin (sf0.001); rows-only ones must run."""
import os

import pytest

import __spark_entry__ as ent
from oracle_check import compare, duck
from tessera.plans.catalog import QUERIES
from tessera.plans.oracle import ORACLE

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    line = compare(spark, con, SF, name, ent.queries()[name], ent.oracle_sql().get(name))
    assert "MISMATCH" not in line, line


def test_entry_runs(spark):
    df = ent.entry(spark)
    assert set(df.columns) == {"user_id", "item_id", "rating", "prediction"}
    assert df.count() >= 0


def test_oracle_keys_are_registered_queries():
    q, o = ent.queries(), ent.oracle_sql()
    assert set(o) <= set(q) and set(QUERIES) <= set(q)
    assert len(QUERIES) - len(ORACLE) == 14  # rows-only: iterative / randomised ML fits and timings
