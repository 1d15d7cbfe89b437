"""Every registered query against its SQL twin, and the ones without a twin for rows."""

import pytest
from compare import connect, differences
from conftest import SF_DIR

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert differences(spark, con, contract.queries()[name], contract.oracle_sql()[name], SF_DIR) == []


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_has_rows(spark, name):
    assert contract.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["metric", "value"]
