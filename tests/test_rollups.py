"""Nodes, covers and page trees beside sums over all days."""

import datetime
import random
import threading

import pytest
from pyspark.sql import functions as F

from hitloom.operators import panels, windows
from hitloom.plans import rollups, tables
from hitloom.plans.beside import at_once
from hitloom.plans.tables import Tables

CUBE = "site_id int, datum date, dim string, parent string, dimkey string, pv long, v long"
DAILY = "site_id int, datum date, visits long, pageviews long, uniques long, bounces long, bytes long"
D = datetime.date
URLS = ["/", "/a", "/a/", "/a/b", "/a/b/", "/a/b/c", "/a//b", "//a", "/b?x=/y/z", "http://h/x", "*", "", "/ab", "/a/b/d/e/f"]


def rows_of(seed, days, sites=(1, 2)):
    draw = random.Random(seed)
    out = []
    for site in sites:
        for day in days:
            out += [(site, day, "url", None, u, draw.randint(1, 9), draw.randint(0, 3)) for u in draw.sample(URLS, 6)]
            out += [(site, day, "browser", None, b, draw.randint(1, 9), draw.randint(0, 9)) for b in ("x", "y", "z")]
            out += [(site, day, "browser_version", "x", b, draw.randint(1, 9), draw.randint(0, 9)) for b in ("x 1", "x 2")]
    return out


@pytest.fixture
def store(spark, tmp_path):
    return Tables(spark, str(tmp_path / "store"))


def put(spark, store, rows, **more):
    daily = sorted({(r[0], r[1], 1, 1, 1, 0, 0) for r in rows})
    tables.replace_days(store, spark.createDataFrame(rows, CUBE), spark.createDataFrame(daily, DAILY), **more)


def right(spark, store):
    """Each node as the sum of its days, and the page trees of all days, by a full reckoning."""
    cube = store.read("cube").withColumn("n", F.unix_date("datum"))
    want = set()
    for size in rollups.LEVELS:
        sums = cube.groupBy("site_id", F.floor(F.col("n") / size).cast("int").alias("node"), "dim", "parent", "dimkey").agg(F.sum("pv"), F.sum("v"))
        want |= {(size, *r) for r in sums.collect()}
    got = [(r.level, r.site_id, r.node, r.dim, r.parent, r.dimkey, r.pv, r.v) for r in store.read("nodes").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    pages = sorted(map(repr, panels.page_rows(store.read("cube")).collect()))
    assert sorted(map(repr, store.read("pages").select("site_id", "datum", "parent", "segment", "pv", "v", "below").collect())) == pages


def test_cover():
    draw = random.Random(1)
    for _ in range(300):
        first = draw.randrange(-2000, 30_000)
        last = first + draw.choice([-1, 0, 1, 29, 89, 364, 3000])
        parts = rollups.cover(first, last)
        assert [d for size, n in parts for d in range(size * n, size * n + size)] == list(range(first, last + 1))
        assert len(parts) <= 24 + max(0, last - first) // 256


def test_only_touched_nodes_are_written(spark, store):
    start = D(2024, 12, 20)
    put(spark, store, rows_of(1, [start + datetime.timedelta(days=i) for i in range(30)]))
    rollups.build(store)
    right(spark, store)
    files = lambda: {f for f in spark.read.parquet(store.path("nodes")).inputFiles()}
    before = files()
    put(spark, store, rows_of(2, [D(2025, 1, 3)], sites=(1,)))
    right(spark, store)
    kept = {"/".join(f.split("/")[-4:-1]) for f in before & files()}
    changed = {(1, s, rollups.number(D(2025, 1, 3)) // s) for s in rollups.LEVELS}
    assert {tuple(int(p.split("=")[1]) for p in k.split("/")) for k in kept} == {(r.site_id, r.level, r.node) for r in store.read("nodes").select("site_id", "level", "node").distinct().collect()} - changed
    # Days that are gone take their nodes along.
    tables.replace_days(store, *tables.empty_batch(spark), site=2, day_from="2024-01-01", day_to="2026-01-01")
    right(spark, store)
    assert store.read("nodes").where("site_id = 2").count() == 0


def test_a_stop_before_the_nodes_is_made_up_for(spark, store, monkeypatch):
    put(spark, store, rows_of(1, [D(2025, 1, i) for i in range(1, 9)]))
    rollups.build(store)
    with monkeypatch.context() as broken:
        broken.setattr(rollups, "refresh", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            put(spark, store, rows_of(3, [D(2025, 1, 2)]))
    put(spark, store, rows_of(4, [D(2025, 1, 7)]))
    right(spark, store)


def test_ranges_and_presets_as_live(spark, store):
    days = [D(2023, 11, 1) + datetime.timedelta(days=i) for i in range(0, 460, 7)]
    put(spark, store, rows_of(5, days))
    rollups.build(store)
    cube = store.read("cube")
    for a, b in (("2023-11-01", "2025-02-02"), ("2024-01-01", "2024-12-31"), ("2024-03-03", "2024-03-03"), ("2020-01-01", "2020-02-01")):
        rolled = rollups.read_range(store, 1, a, b)
        assert panels.dim_totals(rolled, 1, a, b, "url").orderBy("dimkey").collect() == panels.dim_totals(cube, 1, a, b, "url").orderBy("dimkey").collect()
        assert panels.top_n_live(rolled, 1, a, b, "browser_version", parent="x").collect() == panels.top_n_live(cube, 1, a, b, "browser_version", parent="x").collect()
    sites = spark.createDataFrame([(1, "A"), (2, "B")], "site_id int, site string")
    tables.rebuild_meta(store, sites)
    meta = store.read("meta")
    tables.rebuild_topn(store, sites)
    assert sorted(map(repr, store.read("topn").select(*panels.topn_table(cube, meta).columns).collect())) == sorted(map(repr, panels.topn_table(cube, meta).collect()))
    read = rollups.rows_by_window(store, windows.preset_windows(meta)).where("win = 'all'").count()
    assert read < 0.7 * cube.count()


@pytest.mark.parametrize("path", ["", "/a", "/a/b", "/a/", "http:/", "/none", "/"])
def test_page_trees(spark, store, path):
    cube = spark.createDataFrame(rows_of(6, [D(2025, 1, i) for i in range(1, 6)]), CUBE)
    pages, ask = panels.page_rows(cube), (1, "2025-01-01", "2025-01-04", path)
    for metric, limit, offset in (("pv", 8, 0), ("v", 2, 1)):
        assert panels.stored_tree_children(pages, *ask, metric, limit, offset).collect() == panels.url_tree_children(cube, *ask, metric, limit, offset).collect()
        for depth in (1, 2):
            got, want = (sorted(map(str, f(x, *ask, metric, limit, offset, depth).collect())) for f, x in ((panels.stored_tree, pages), (panels.url_tree, cube)))
            assert got == want


def test_pages_are_written_while_nodes_are(spark, store, monkeypatch):
    store.write("cube", spark.createDataFrame([(1, D(2024, 1, 5), "url", None, "/a/b", 2, 1)], CUBE))
    begun, met = {"nodes": threading.Event(), "pages": threading.Event()}, []

    def meeting(name, other, work):
        def inner(*given):
            begun[name].set()
            met.append(begun[other].wait(30))
            return work(*given)

        return inner

    monkeypatch.setattr(rollups, "node_rows", meeting("nodes", "pages", rollups.node_rows))
    monkeypatch.setattr(rollups, "page_rows", meeting("pages", "nodes", rollups.page_rows))
    rollups.build(store)
    assert all(met) and store.read("pages").count() and store.read("nodes").count() == len(rollups.LEVELS)


def test_an_error_beside_goes_on(spark):
    with pytest.raises(ZeroDivisionError), at_once(spark) as beside:
        beside(lambda: 1 // 0)
