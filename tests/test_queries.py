"""Every query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from sievework.plans.catalogue import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    assert_same(df.collect(), df.columns, duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
