"""The registered corpus queries that SQL can express, beside their SQL."""

import pytest
from compare import differences, views

from hitloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    found = queries.queries()[name](spark, SF)
    assert differences(found, views(SF), queries.oracle_sql()[name]) == ""
    assert found.head(1)
