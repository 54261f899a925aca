"""Every registered query next to its SQL, and the driver contract."""

import pytest
from conftest import SF
from oracle_check import compare, connect

import __spark_entry__ as entry
from tasador.queries.catalog import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    flagship = entry.entry(spark)
    assert flagship.columns == ["id", "precio", "umbral", "diferencia"] and flagship.count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(entry.oracle_sql())))
def test_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""
