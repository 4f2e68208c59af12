"""Queries of the subpackage against their SQL."""

import pytest

from sparsemill.llm.queries import R
from tests.test_queries import DIR, connect, same


@pytest.mark.parametrize("name", sorted(R.sql))
def test_query(spark, name):
    same(R.queries[name](spark, DIR), R.sql[name], connect())
