import duckdb
import pytest

import __spark_entry__ as entry_module
from workloads.oracles import ORACLES
from workloads.queries import QUERIES
from tools.check_oracle import canonical, duck

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection: duckdb.DuckDBPyConnection = duck(SMALL)
    yield connection
    connection.close()


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["source", "n_rows"]


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    expected = con.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)
