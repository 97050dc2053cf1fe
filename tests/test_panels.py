"""Questions asked of small cubes."""

import datetime

import pytest

from hitloom.operators import panels, windows
from hitloom.plans import checks, dashboards
from pyspark.sql import functions as F

DAY = datetime.date(2026, 6, 1)
RANGE = ("2026-06-01", "2026-06-30")
SCHEMA = "site_id int, datum date, dim string, parent string, dimkey string, pv long, v long"


def cube(spark, *rows, dim="keyword"):
    """Rows (key, pv, v) or (key, pv, v, parent, day, site)."""
    full = [(*r, *(None, DAY, 1)[len(r) - 3 :]) for r in rows]
    return spark.createDataFrame([(site, day, dim, parent, key, pv, v) for key, pv, v, parent, day, site in full], SCHEMA)


def keys(df):
    return [r.dimkey for r in df.collect()]


def test_top_n_orders_and_pages(spark):
    c = cube(spark, ("a", 1, 1), ("b", 1, 5), ("c", 1, 3))
    assert keys(panels.top_n(c, 1, *RANGE, "keyword", limit=2)) == ["b", "c"]
    assert keys(panels.top_n(c, 1, *RANGE, "keyword", limit=2, offset=2)) == ["a"]
    assert keys(panels.top_n(c, 2, *RANGE, "keyword")) == []
    with pytest.raises(ValueError):
        panels.top_n(c, 1, *RANGE, "keyword", metric="pv; drop")


def test_top_n_sums_days(spark):
    c = cube(spark, ("rathaus", 3, 2), ("rathaus", 4, 1, None, datetime.date(2026, 6, 2), 1))
    assert tuple(panels.top_n(c, 1, *RANGE, "keyword").first()) == ("rathaus", 7, 3)


def test_summary(spark):
    c = cube(spark, ("a", 1, 2), ("b", 3, 4), ("", 99, 99), (None, 9, 9))
    assert tuple(panels.dim_summary(c, 1, *RANGE, "keyword").first()) == (4, 6, 2)
    assert tuple(panels.dim_summary(c, 1, *RANGE, "other").first()) == (0, 0, 0)
    assert keys(panels.top_n(c, 1, *RANGE, "keyword")) == ["b", "a"]


def test_children_of_one_parent(spark):
    c = cube(spark, ("120", 1, 5, "Chrome", DAY, 1), ("119", 1, 2, "Chrome", DAY, 1), ("115", 1, 1, "Firefox", DAY, 1), ("9", 1, 1, "Chrom", DAY, 1), dim="browser_version")
    assert keys(panels.top_n(c, 1, *RANGE, "browser_version", parent="Chrome")) == ["120", "119"]
    assert keys(panels.top_n(c, 1, *RANGE, "browser_version", parent="Chrom")) == ["9"]


def tree(df):
    return [(r.segment, r.pv, r.v, r.has_children, r.n) for r in df.collect()]


def test_tree_levels(spark):
    c = cube(spark, ("/a", 5, 3), ("/a/x", 2, 1), ("/a/y", 1, 1), ("/b", 4, 2), ("/", 7, 7), ("/b/", 1, 1), dim="url")
    assert tree(panels.url_tree_children(c, 1, *RANGE)) == [("a", 8, 5, True, 2), ("b", 5, 3, False, 2)]
    c = cube(spark, ("/a", 5, 3), ("/a/x", 2, 1), ("/a/x/tief", 1, 1), ("/ab", 9, 9), dim="url")
    assert tree(panels.url_tree_children(c, 1, *RANGE, "/a")) == [("x", 3, 2, True, 1)]
    c = cube(spark, ("/eins", 3, 3), ("/zwei", 2, 2), ("/drei", 1, 1), dim="url")
    assert [r[0] for r in tree(panels.url_tree_children(c, 1, *RANGE, limit=2))] == ["eins", "zwei"]
    assert tree(panels.url_tree_children(c, 1, *RANGE, limit=2, offset=2)) == [("drei", 1, 1, False, 3)]


def test_tree_of_two_levels(spark):
    c = cube(spark, ("/a/x", 2, 1), ("/b", 1, 1), ("/a//z", 1, 1), dim="url")
    rows = {r.path: (r.level, r.parent_path, r.pv, r.has_children) for r in panels.url_tree(c, 1, *RANGE).collect()}
    assert rows == {"/a": (1, "", 3, True), "/b": (1, "", 1, False), "/a/x": (2, "/a", 2, False)}


def test_windows():
    resolve = windows.resolve_window
    assert resolve("2025-01-01", "2026-06-30") == ("2026-03-31", "2026-06-30")
    assert resolve("2026-06-01", "2026-06-30") == ("2026-06-01", "2026-06-30")
    assert resolve("2025-01-01", "2026-06-30", 92, "2026-02-31", "2030-01-01") == ("2026-03-31", "2026-06-30")
    assert resolve("2025-01-01", "2026-06-30", 92, "2024-01-01", "2025-02-01") == ("2025-01-01", "2025-02-01")
    assert resolve("2025-01-01", "2026-06-30", 0) == ("2025-01-01", "2026-06-30")
    assert resolve("2025-01-01", "2026-06-30", 92, "2026-06-30", "2026-06-01") == ("2026-06-01", "2026-06-01")
    assert resolve(None, "") == ("1970-01-01", "1970-01-01")


def test_presets():
    preset = lambda name, today="2026-03-15": windows.preset_range(name, "2024-06-01", "2026-03-10", today)
    assert preset("today") == ("2026-03-10", "2026-03-10")
    assert preset("last7") == ("2026-03-04", "2026-03-10")
    assert preset("yesterday", "2026-03-05") == ("2026-03-04", "2026-03-04")
    assert preset("lastmonth") == ("2026-02-01", "2026-02-28")
    assert preset("thismonth") == ("2026-03-01", "2026-03-10")
    assert preset("year:2024") == ("2024-06-01", "2024-12-31")
    assert preset("all") == ("2024-06-01", "2026-03-10") and preset("custom") is None
    assert windows.window_bounds("lastyear", "2026-01-01", "2026-03-10") is None
    assert windows.previous_period("2026-03-08", "2026-03-10", "2026-03-05") == ("2026-03-05", "2026-03-07")
    assert windows.previous_period("2026-03-08", "2026-03-10", "2026-03-06") is None


def test_window_tables_agree(spark):
    meta = spark.createDataFrame([(1, "2025-12-30", "2026-03-10"), (2, "2026-02-01", "2026-03-10")], "site_id int, von string, bis string")
    rows = {(r.site_id, r.win): (str(r.wfrom), str(r.wto)) for r in windows.preset_windows(meta).collect()}
    for site, von, bis in ((1, "2025-12-30", "2026-03-10"), (2, "2026-02-01", "2026-03-10")):
        for name in windows.PRECOMPUTED:
            assert rows.get((site, name)) == windows.window_bounds(name, von, bis), (site, name)
    chunks = [(str(r.chunk_from), str(r.chunk_to)) for r in windows.month_chunks(spark, "2025-12-30", "2026-02-10").collect()]
    assert chunks == [("2025-12-30", "2025-12-31"), ("2026-01-01", "2026-01-31"), ("2026-02-01", "2026-02-10")]


def test_precomputed_rows_equal_live_ones(spark):
    c = cube(spark, *[(f"k{i:02}", i % 7, i % 5) for i in range(30)], *[("k01", 50, 50, None, datetime.date(2026, 5, 1), 1)])
    meta = spark.createDataFrame([(1, "2026-05-01", "2026-06-01")], "site_id int, von string, bis string")
    topn = panels.topn_table(c, meta)
    for name in windows.PRECOMPUTED:
        bounds = windows.window_bounds(name, "2026-05-01", "2026-06-01")
        if bounds:
            live = panels.top_n(c, 1, *bounds, "keyword", limit=6, offset=3).collect()
            assert panels.top_n(c, 1, *bounds, "keyword", limit=6, offset=3, window=name, topn=topn, meta=meta).collect() == live
    stale = topn.where("false")
    assert panels.top_n(c, 1, "2026-05-01", "2026-06-01", "keyword", window="all", topn=stale, meta=meta).count() == 8


def daily(spark, *rows):
    return spark.createDataFrame([(1, datetime.date(2026, 6, d), *n) for d, *n in rows], "site_id int, datum date, visits long, pageviews long, uniques long, bounces long, bytes long")


def test_key_figures(spark):
    d = daily(spark, (1, 10, 20, 5, 5, 0), (2, 0, 0, 0, 0, 0), (3, 20, 20, 5, 5, 7), (4, 0, 10, 1, 0, 0))
    row = panels.kpis(d, 1, "2026-06-03", "2026-06-04").first()
    assert (row.visits, row.pageviews, row.bounce_rate) == (20, 30, 25.0)
    assert panels.kpis(d, 1, "2026-07-01", "2026-07-02").first().bounce_rate is None
    found = {r.kpi: (r.delta, r.trend, r.good) for r in panels.kpi_deltas(d, 1, "2026-06-03", "2026-06-04", "2026-06-01").collect()}
    assert found["visits"] == (100.0, "up", True) and found["bytes"] == (None, "new", None)
    assert found["bounce_rate"] == (-50.0, "down", True) and found["bounces"] == (0.0, "flat", None)
    assert all(r.prev is None and r.trend is None for r in panels.kpi_deltas(d, 1, "2026-06-03", "2026-06-04", "2026-06-02").collect())
    shown = panels.trend(d, 1, "2026-06-03", "2026-06-04", "2026-06-01", compare=True).collect()
    assert [(r.pageviews, r.pageviews_prev) for r in shown] == [(20, 20), (10, 0)]


def test_profiles(spark):
    hours = panels.hour_profile(cube(spark, ("07", 3, 2), dim="hour"), 1, *RANGE).collect()
    assert len(hours) == 24 and hours[7].pv == 3 and hours[8].pv == 0
    rows = panels.country_intensity(cube(spark, ("DE", 1, 16), ("FR", 1, 4), ("??", 1, 99), dim="country"), 1, *RANGE).collect()
    assert {r.dimkey: r.intensity for r in rows} == {"DE": 1.0, "FR": 0.5}


def test_share(spark):
    c = cube(spark, ("a", 1, 1), ("b", 1, 6), ("c", 1, 3))
    page = panels.with_share(panels.top_n(c, 1, *RANGE, "keyword", limit=2), panels.dim_summary(c, 1, *RANGE, "keyword")).orderBy(F.desc("v")).collect()
    assert [(r.share, r.bar, r.more) for r in page] == [(60.0, 100.0, 1), (30.0, 50.0, 1)]


def test_visible_sites(spark):
    meta = spark.createDataFrame([(1, "A"), (2, "B")], "site_id int, site string")
    some = lambda *ids: spark.createDataFrame([(i,) for i in ids], "site_id int")
    assert panels.visible_sites(meta, None).count() == 2
    assert panels.visible_sites(meta, some()).count() == 0
    assert [r.site for r in panels.visible_sites(meta, some(2, 9)).collect()] == ["B"]


def test_freshness(spark):
    meta = spark.createDataFrame(
        [(1, "A", "2026-06-01", "UTC"), (2, "B", "2026-05-31", "UTC"), (3, "C", "2026-05-30", None), (4, "D", None, "UTC"), (5, "E", "soon", "UTC"), (6, "F", "2026-06-01", "America/New_York")],
        "site_id int, site string, bis string, tz string",
    )
    rows = checks.freshness(meta, F.lit("2026-06-02 02:30:00").cast("timestamp"))
    assert {r.site: (r.status, r.age_hours) for r in rows.collect()} == {"A": ("OK", 2), "B": ("WARN", 26), "C": ("CRIT", 50), "D": ("CRIT", None), "E": ("UNKNOWN", None), "F": ("OK", -2)}
    assert tuple(checks.freshness_summary(rows).first()) == ("UNKNOWN", 2, 6)
    assert checks.freshness_summary(rows.where("false")).first().status == "CRIT"
    with pytest.raises(ValueError):
        checks.freshness(meta, F.current_timestamp(), 50, 26)


def test_csv_cells(spark):
    rows = spark.createDataFrame([("=1+1",), ('a"b',), ("x;y",), (None,), ("plain",), ("-5",)], "t string")
    assert [r.c for r in rows.select(dashboards.csv_safe(F.col("t")).alias("c")).collect()] == ["'=1+1", '"a""b"', '"x;y"', "", "plain", "'-5"]


def test_dashboard_and_report(spark, tmp_path):
    c = cube(spark, ("DE", 4, 2), dim="country").unionByName(cube(spark, ("/a/x", 4, 2), dim="url")).unionByName(cube(spark, ("=kw", 1, 1)))
    d = daily(spark, (1, 2, 4, 1, 1, 9))
    meta = spark.createDataFrame([(1, "Site; A", "2026-06-01", "2026-06-01", "2026-06-02 01:00")], "site_id int, site string, von string, bis string, erzeugt string")
    board = dashboards.dashboard(c, d, meta, 1)
    assert board["window"] == ("2026-06-01", "2026-06-01") and board["daily"].count() == 1
    assert [r.dim for r in board["cube"].collect()] == ["country"] and board["tree"].count() == 2
    hidden = dashboards.dashboard(c, d, meta, 1, allowed=meta.select("site_id").where("false"))
    assert hidden["window"] == windows.EMPTY and hidden["cube"].count() == 0
    dashboards.write_csv_report(dashboards.csv_report(c, d, meta, 1, *RANGE), str(tmp_path / "report"))
    (part,) = (tmp_path / "report").glob("part-*")
    text = part.read_bytes().decode()
    assert text.startswith("﻿Web statistics export\r\n") and 'Website;"Site; A"\r\n' in text
    assert "2026-06-01;2;4;1;1;9\r\n" in text and "DE;2;4;2\r\n" in text and "'=kw;1;1;1\r\n" in text
