"""The operators' queries against their SQL, and all of them for rows."""

from __future__ import annotations

import pytest

from sievework.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert_same(df.collect(), df.columns, connect(sf_dir), ORACLE_SQL[name])


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
