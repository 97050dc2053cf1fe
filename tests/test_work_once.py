"""Steps that were done twice for each line: a plan says how often."""

import pytest
from pyspark.sql import functions as F

from hitloom.operators import sessions
from hitloom.plans import queries
from hitloom.plans.importing import ImportConfig, import_sites, parsed_hits

AGENT = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/108.0.5359.124 Safari/537.36"


def _plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def _lines(spark, agents):
    line = '1.1.1.1 - - [10/Jan/2026:10:0{}:00 +0000] "GET /a HTTP/1.1" 200 10 "-" "{}"'
    return spark.createDataFrame([(1, i, line.format(i, a)) for i, a in enumerate(agents)], "site_id int, rid long, line string")


def test_a_time_is_read_once_and_an_agent_lowered_once(spark):
    plan = _plan(parsed_hits(_lines(spark, [AGENT]), ImportConfig()))
    assert plan.count("gettimestamp(") == 2  # one for each way to write an offset
    assert plan.count("lower(") == 2  # the agent, and the url for downloads


def test_hits_of_a_slice_are_joined_where_the_windows_put_them(spark):
    rows = spark.createDataFrame([(1, "a", 0), (1, None, 1)], "site_id int, vkey string, rid int").withColumn("ts", F.timestamp_seconds(F.col("rid") * 4000))
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = sessions.sessionize(rows)
        # Hits by slice for the windows, narrow ones for the spans, spans by visitor, and these by slice.
        assert _plan(found).count("Exchange hashpartitioning") == 4
        assert sorted((r.vkey or "", r.new_session, r.seq) for r in found.collect()) == [("", 1, 1), ("a", 1, 1)]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_what_agents_tell_is_told_of_visits(spark):
    kept = import_sites(_lines(spark, [AGENT, AGENT]), ImportConfig())
    assert "browser" not in kept.sess.columns
    (visit,) = kept.visits.collect()
    assert (visit.pageviews, visit.browser, visit.browser_version, visit.os, visit.device) == (2, "Chrome", "Chrome 108.0.5359.124", "Linux", "Desktop")


@pytest.mark.parametrize("name", ["dsh_tree", "snk_csv_report", "tk_topn_table"])
def test_cube_days_and_meta_are_of_one_analysis(spark, monkeypatch, name):
    calls = []

    def seen(lines, config):
        calls.append(1)
        return import_sites(lines, config)

    monkeypatch.setattr(queries, "import_sites", seen)
    try:
        assert queries.queries()[name](spark, "/root/testdata/sf0.001").columns
        assert len(calls) == 1
    finally:
        spark.catalog.clearCache()


def test_lines_are_made_after_their_events_are_dealt(spark):
    plan = _plan(queries._dealt_log(spark, "/root/testdata/sf0.001", late=F.lit(0)))
    assert "concat_ws(" in plan and "concat_ws(" not in plan[plan.index("rangepartitioning") :]


def test_dealt_lines_are_those_of_the_log(spark):
    rows = queries._dealt_log(spark, "/root/testdata/sf0.001", late=(F.to_date("ts") >= "2024-01-11").cast("int"))
    want = queries._log(spark, "/root/testdata/sf0.001")
    day = F.to_date(F.regexp_extract("line", r"\[(\d+/\w+/\d+)", 1), "dd/MMM/yyyy")
    assert rows.where(F.col("late") != (day >= F.lit("2024-01-11").cast("date")).cast("int")).count() == 0
    assert sorted(rows.drop("late").collect()) == sorted(want.collect())
