"""The functions of Spark SQL beside those of Python."""

import json

import pytest
from pyspark.sql import functions as F

from hitloom.functions import sql
from hitloom.functions.agents import windows_version
from hitloom.operators.agents import bounded_pattern, filled_version
from hitloom.sources.reports import read_report_dim


@pytest.fixture(autouse=True)
def registered(spark):
    sql.register(spark)
    sql.register(spark)  # again is no error


def test_scalars(spark):
    rows = [
        ("Chrome/12.3 x", r"Chrome/(\d+)\.(\d+)", "$1.$2."), ("chrome/12", r"Chrome/(\d+)", " v$1 "), ("Edg/1", r"Edg/(\d+)", "$1.$2"), ("X Foo", "Foo", "$1"),
        ("a'b\\c Foo", "Foo", None), ("none", "Foo(x)", "$1$1"), (None, "Foo", "$1"), ("10.0", "6.3", "6.1.7601"), ("xChrome/1", r"Chrome/(\d+)", "$1"),
    ]
    frame = spark.createDataFrame(rows, "ua string, regex string, template string")
    frame.createOrReplaceTempView("sql_rows")
    got = spark.sql("SELECT bounded_pattern(regex) AS p, filled_version(ua, bounded_pattern(regex), template) AS v, windows_version(template) AS w, ua RLIKE bounded_pattern(regex) AS met FROM sql_rows")
    p = bounded_pattern(F.col("regex"))
    want = frame.select(p.alias("p"), filled_version(F.col("ua"), p, F.col("template")).alias("v"), windows_version(F.col("template")).alias("w"), F.rlike("ua", p).alias("met"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_report_rows(spark, tmp_path):
    days = {
        "2026-06-01": [{"label": "a", "nb_visits": "3", "nb_actions": 5}, {"label": "b"}, {"nb_visits": 1}, {"label": "ü'x", "nb_visits": 2, "nb_actions": "7"}, {"label": None, "nb_visits": 9}],
        "2026-06-02": [], "2026-06-03": {"result": "error"}, "not a day": [{"label": "z", "nb_visits": 1}], "2026-06-04": [{"label": 17, "nb_visits": "x", "nb_actions": 4}],
    }
    (tmp_path / "1.json").write_text(json.dumps(days))
    (tmp_path / "2.json").write_text("{}")
    (tmp_path / "3.json").write_text("no json at all")
    spark.read.text(str(tmp_path), wholetext=True).createOrReplaceTempView("sql_files")
    got = spark.sql("SELECT r.* FROM sql_files f, LATERAL report_rows(f.value, 'browser', 'nb_actions', 'nb_visits', 'label') r")
    want = read_report_dim(spark, str(tmp_path / "1.json"), "browser", "nb_actions", "nb_visits", "label")
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 4
