import os

import pytest
from compare import connect, difference

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    assert difference(contract.queries()[name](spark, FOLDER), connection, contract.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    got = contract.entry(spark)
    assert got.columns == ["user_name", "rank", "item", "prediction"]
    assert got.count() > 0
