"""Every registered query against its DuckDB oracle on the smallest tables
(the driver repeats this at sf0.01)."""

import pytest

import __spark_entry__ as E
from gridmeter.plans import catalog
from tools.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    n, problems = compare(spark, con, SF, QUERIES[name], SQL.get(name), types=True)
    assert not problems, problems
    assert n >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["meter_customer_code", "meter_type", "slot_start", "energy_kwh",
                          "imputation_method", "tariff"]
    assert df.count() > 0


def test_every_query_but_one_has_an_oracle():
    assert set(QUERIES) - set(SQL) == {"table_bytes"}
