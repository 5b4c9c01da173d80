"""Every registered query against its SQL, and the driver's entry points."""

from __future__ import annotations

import pytest
from conftest import SMALL
from oracle import compare, connect

import __spark_entry__ as driver
from gavelspark.plans import PLANS, SQL


@pytest.fixture(scope="module")
def con():
    connection = connect(SMALL)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    _, _, problem = compare(spark, con, PLANS[name], SQL[name], SMALL)
    assert problem is None


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["window_start", "window_end", "auction", "price", "bidder"] and df.count() == 989


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
