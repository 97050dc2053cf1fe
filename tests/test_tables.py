"""Stored tables: replacing, undoing, purging, migrating; report history."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from hitloom.operators import panels
from hitloom.plans import checks, metrics, tables
from hitloom.plans.tables import Tables
from hitloom.sources import reports
from hitloom.sources.growing import stream_log_files

D = datetime.date
CUBE = "site_id int, datum date, dim string, parent string, dimkey string, pv long, v long"
DAILY = "site_id int, datum date, visits long, pageviews long, uniques long, bounces long, bytes long"


def batch(spark, *days, site=1, n=1):
    cube = spark.createDataFrame([(site, d, "url", None, "/a", n, n) for d in days], CUBE)
    return cube, spark.createDataFrame([(site, d, n, n, n, 0, 10 * n) for d in days], DAILY)


def stored(t):
    return {(r.site_id, r.datum.day): r.visits for r in t.read("daily").collect()}


@pytest.fixture
def store(spark, tmp_path):
    return Tables(spark, str(tmp_path / "store"))


def test_replace_days(spark, store):
    assert store.read("cube").count() == 0
    tables.replace_days(store, *batch(spark, D(2026, 6, 1), D(2026, 6, 2), D(2026, 6, 3)))
    tables.replace_days(store, *batch(spark, D(2026, 6, 2), site=2))
    # A batch of the 1st and 3rd covers the 2nd too, which it lacks.
    for _ in range(2):
        tables.replace_days(store, *batch(spark, D(2026, 6, 1), D(2026, 6, 3), n=5))
        assert stored(store) == {(1, 1): 5, (1, 3): 5, (2, 2): 1}
    tables.replace_days(store, *tables.empty_batch(spark), site=1, day_from="2026-06-03", day_to="2026-06-09")
    assert stored(store) == {(1, 1): 5, (2, 2): 1} and store.read("cube").count() == 2
    with pytest.raises(ValueError):
        tables.replace_days(store, *tables.empty_batch(spark), day_from="2026-06-03")


def test_meta_topn_and_checks(spark, store):
    tables.replace_days(store, *batch(spark, D(2026, 6, 1), D(2026, 6, 2)))
    tables.replace_days(store, *batch(spark, D(2026, 6, 2), site=2))
    sites = spark.createDataFrame([(1, "A"), (2, "B")], "site_id int, site string")
    tables.rebuild_meta(store, sites, "UTC")
    tables.rebuild_topn(store, sites)
    rows = {r.site: (r.von, r.bis, r.visits_total) for r in store.read("meta").collect()}
    assert rows == {"A": ("2026-06-01", "2026-06-02", 2), "B": ("2026-06-02", "2026-06-02", 1)}
    assert store.read("topn").count() == 0  # pages have a tree instead
    checks.assert_schema(store.read("meta"))
    with pytest.raises(ValueError):
        checks.assert_schema(store.read("meta").withColumn("schema_version", F.lit(3)))
    assert checks.schema_version(spark.range(1)) is None
    assert all(r.ok for r in checks.smoke(store).collect())
    assert {r.site_id: (r.cube, r.daily, r.topn) for r in checks.table_counts(store).collect()} == {1: (2, 2, 0), 2: (1, 1, 0)}
    assert [r.site for r in panels.sites(store.read("meta")).collect()] == ["A", "B"]
    # One site's meta is rebuilt without touching the other's.
    tables.replace_days(store, *batch(spark, D(2026, 6, 5)))
    tables.rebuild_meta(store, sites.where("site_id = 1"))
    assert {r.site: r.bis for r in store.read("meta").collect()} == {"A": "2026-06-05", "B": "2026-06-02"}


def test_purge(spark, store):
    tables.replace_days(store, *batch(spark, D(2026, 1, 31), D(2026, 2, 28), D(2026, 3, 1)))
    counts = lambda df: {r.table: r.n for r in df.collect()}
    assert counts(tables.purge(store, 1, "2026-03-31", dry_run=True)) == {"cube": 1, "daily": 1}
    assert store.read("daily").count() == 3
    tables.purge(store, 1, "2026-03-31")
    assert stored(store) == {(1, 28): 1, (1, 1): 1}
    for bad in (0, -1, "x", 1.5, True):
        with pytest.raises(ValueError):
            tables.purge(store, bad, "2026-03-31")


def test_serving_copy(spark, store, tmp_path):
    """A database inside the session's own JVM stands for the server."""
    url, properties = f"jdbc:derby:{tmp_path}/served;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    served = lambda name="daily": spark.read.jdbc(url, name, properties=properties)
    days = lambda: {(r.site_id, r.datum.day): r.visits for r in served().collect()}
    sites = spark.createDataFrame([(1, "A"), (2, "B")], "site_id int, site string")
    tables.replace_days(store, *batch(spark, *[D(2026, 6, d) for d in (1, 2, 3)]))
    tables.replace_days(store, *batch(spark, D(2026, 6, 2), site=2))
    tables.rebuild_meta(store, sites)
    for _ in range(2):
        tables.publish_jdbc(store, url, properties)
        assert days() == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (2, 2): 1}
    # Days change, one goes; only those asked for are taken over, and the meta of their site.
    tables.replace_days(store, *batch(spark, D(2026, 6, 1), D(2026, 6, 3), n=5))
    tables.replace_days(store, *batch(spark, D(2026, 6, 2), site=2, n=7))
    tables.rebuild_meta(store, sites)
    for _ in range(2):
        tables.publish_jdbc(store, url, properties, 1, "2026-06-02", "2026-06-09")
        assert days() == {(1, 1): 1, (1, 3): 5, (2, 2): 1}
        assert {r.site: r.visits_total for r in served("meta").collect()} == {"A": 10, "B": 1}
    assert served("cube").count() == 3 and served("topn").count() == 0
    # Nothing changes if a step fails.
    with pytest.raises(Exception, match="(?i)nowhere"):
        tables._in_one_transaction(spark, url, properties, ["DELETE FROM daily", "DELETE FROM nowhere"])
    assert len(days()) == 3
    with pytest.raises(ValueError):
        tables.publish_jdbc(store, url, properties, day_from="2026-06-02")


def test_migration(spark):
    day = D(2026, 1, 1)
    old = spark.createDataFrame(
        [(1, day, "browser_version", "Chrome\x1fChrome 1\x1f2", 1, 1), (1, day, "referrer_type", "Suchmaschine", 1, 1), (1, day, "referrer_name", "Direkt\x1fx", 1, 1), (1, day, "url", "/a\x1fb", 1, 1)],
        "site_id int, datum date, dim string, dimkey string, pv long, v long",
    )
    meta = spark.createDataFrame([(1, "A")], "site_id int, site string")
    cube, new = tables.migrate_v1_to_v2(old, meta)
    want = {("browser_version", "Chrome", "Chrome 1\x1f2"), ("referrer_type", None, "search"), ("referrer_name", "direct", "x"), ("url", None, "/a\x1fb")}
    assert {(r.dim, r.parent, r.dimkey) for r in cube.collect()} == want
    assert (new.first().tz, new.first().schema_version) == ("UTC", 2)
    again = tables.migrate_v1_to_v2(cube, new)[0]
    # The key that still holds a separator is split once more only in a child dimension.
    assert {r.dimkey for r in again.where("dim <> 'browser_version'").collect()} == {"search", "x", "/a\x1fb"}


def test_runs_of_streams(spark, store, tmp_path):
    """A stream that finds lines, one that finds nothing new, and one that fails."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("one\ntwo\n")
    listener = metrics.record_streams(store)
    try:
        for name in ("first", "again", "broken"):
            rows = stream_log_files(spark, str(tmp_path / "in"))
            rows = rows.withColumn("line", F.raise_error(F.lit("unreadable"))) if name == "broken" else rows
            checkpoint = str(tmp_path / ("broken" if name == "broken" else "checkpoint"))
            query = rows.writeStream.format("noop").option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()
            try:
                query.awaitTermination(60)
            except Exception:  # noqa: BLE001 - of the broken one
                assert name == "broken"
        for _ in range(60):
            found = {r.kind: (r.status, r.rows) for r in store.read("runs").collect()}
            if len(found) == 3:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    assert found == {"first": ("done", 2), "again": ("empty", 0), "broken": ("failed", 0)}
    assert "unreadable" in store.read("runs").where("kind = 'broken'").first().message


def test_a_run_without_action_counts_nothing(spark, store, monkeypatch):
    monkeypatch.setattr(metrics, "PATIENCE", 0.2)
    with metrics.recorded(store, "idle") as run:
        run.watch(spark.range(3))
    row = store.read("runs").first()
    assert (row.kind, row.status, row.rows) == ("idle", "done", None) and row.started <= row.ended


def test_run_metrics(spark):
    rows, seen = tables.run_metrics(spark.range(5).withColumn("size", F.lit(3)), "import", "size")
    rows.count()
    assert seen.get == {"rows": 5, "bytes": 15}


@pytest.fixture
def history(tmp_path):
    day = "2026-06-01"
    files = {
        "daily": {day: {"nb_visits": "3", "nb_actions": 5, "nb_uniq_visitors": 3, "bounce_count": 1}, "2026-06-02": []},
        "url": {day: [{"label": "/a", "nb_hits": 3, "nb_visits": 2}, {"label": "/b", "nb_hits": "1", "nb_visits": 1}, {"label": "/zero", "nb_hits": 0}, {"nb_hits": 9}], "2026-06-02": {}},
        "download": {day: [{"label": "/f.pdf", "nb_hits": 1, "nb_visits": 1}]},
        "entry": {day: [{"label": "/a", "entry_nb_actions": 5, "entry_nb_visits": 3}]},
        "exit": {day: [{"label": "/a", "nb_hits": 3, "exit_nb_visits": 2}, {"label": "/b", "nb_hits": 1, "exit_nb_visits": 1}]},
        "country": {day: [{"label": "United States", "code": "us", "nb_visits": 2, "nb_actions": 3}, {"label": "Australia", "code": "au", "nb_visits": 1, "nb_actions": 2}]},
        "browser": {day: [{"label": "Chrome", "nb_visits": 2, "nb_actions": 3}]},
        "os": {day: [{"label": "Windows", "nb_visits": 3, "nb_actions": 5}]},
        "device": {day: [{"label": "Desktop", "nb_visits": 3, "nb_actions": 5}]},
        "reftype": {day: [{"label": "Direct Entry", "nb_visits": 2, "nb_actions": 2}, {"label": "Search Engines", "nb_visits": 1, "nb_actions": 3}, {"label": "Campaigns", "nb_visits": 1, "nb_actions": 1}]},
        "keyword": {},
        "hour": {day: [{"label": "10h", "nb_visits": 1, "nb_actions": 2}, {"label": "0h", "nb_visits": 0, "nb_actions": 0}, {"label": "9h", "nb_visits": 1, "nb_actions": 1}, {"label": "x", "nb_visits": 1, "nb_actions": 1}]},
    }
    for chunk in ("chunk_1",):
        (tmp_path / chunk).mkdir()
        for name, body in files.items():
            (tmp_path / chunk / f"{name}.json").write_text(json.dumps(body, indent=1))
    return str(tmp_path / "chunk_*")


def test_report_history(spark, store, history):
    cube, daily = reports.report_cube(spark, history, site_id=4)
    assert [tuple(r)[1:] for r in daily.collect()] == [(D(2026, 6, 1), 3, 5, 3, 1, 0)]
    cells = {(r.dim, r.dimkey): (r.pv, r.v) for r in cube.collect()}
    assert cells["url", "/a"] == (3, 2) and cells["url", "/b"] == (1, 1) and ("url", "/zero") not in cells
    assert cells["entry", "/a"] == (5, 3) and cells["exit", "/a"] == (3, 2)
    assert cells["country", "US"] == (3, 2) and cells["country", "AU"] == (2, 1)
    assert cells["referrer_type", "direct"] == (2, 2) and cells["referrer_type", "search"] == (3, 1) and cells["referrer_type", "website"] == (1, 1)
    assert {k for d, k in cells if d == "hour"} == {"10", "09"}
    assert all(r.parent is None for r in cube.collect())
    tables.replace_days(store, cube, daily, day_from="2026-06-01", day_to="2026-06-30", site=4)
    assert stored(store) == {(4, 1): 3} and store.read("cube").count() == len(cells)
