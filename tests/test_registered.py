"""Every registered query against its SQL, on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as driver
from compare import connection, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    ours = driver.queries()[name](spark, SF_DIR).toPandas()
    result = duck.sql(driver.oracle_sql()[name])
    theirs = pd.DataFrame(result.fetchall(), columns=result.columns)
    assert differences(ours, theirs) == ""


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(driver.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert driver.queries()[name](spark, SF_DIR).count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
