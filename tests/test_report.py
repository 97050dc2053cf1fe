"""The report lists every country, and the best 100 values of dimensions with a list of best values."""

import datetime

from hitloom.plans import dashboards
from test_panels import RANGE, SCHEMA


def test_all_countries_are_reported(spark):
    day = datetime.date(2026, 6, 1)
    rows = [(1, day, dim, None, f"{dim}{i:03}", 2, 1) for dim in ("country", "keyword") for i in range(120)]
    daily = spark.createDataFrame([], "site_id int, datum date, visits long, pageviews long, uniques long, bounces long, bytes long")
    meta = spark.createDataFrame([(1, "A", "2026-06-02")], "site_id int, site string, erzeugt string")
    report = dashboards.csv_report(spark.createDataFrame(rows, SCHEMA), daily, meta, 1, *RANGE).collect()
    found = lambda dim: [r.line for r in sorted(report, key=lambda r: (r.part, r.nth)) if r.line.startswith(dim)]
    assert found("country") == [f"country{i:03};1;2;1" for i in range(120)]
    assert found("keyword") == [f"keyword{i:03};1;2;1" for i in range(100)]
