"""Every query with an SQL counterpart, side by side on the smallest test tables."""

import pytest

import __spark_entry__ as contract
from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_as_sql(spark, connection, name):
    assert compare(spark, connection, FOLDER, name).startswith("ok")


def test_every_counterpart_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 10
