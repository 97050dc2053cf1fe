"""Every registered web-log query gives the rows of its SQL, and has some."""

import pytest
from compare import differences, views

import __spark_entry__ as entry
from hitloom.plans import oracle, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sql():
    return views(SF)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sql, name):
    found = queries.queries()[name](spark, SF)
    assert differences(found, sql, oracle.oracle_sql()[name]) == ""
    assert found.head(1)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", ["ag_dim_summary", "tk_precomputed", "tw_kpis", "tw_kpi_deltas", "tk_top_n", "snk_csv_report"])
def test_without_rows(spark, name):
    """On the smallest tables the site has no data."""
    tiny = SF.replace("0.01", "0.001")
    assert differences(queries.queries()[name](spark, tiny), views(tiny), oracle.oracle_sql()[name]) == ""
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
