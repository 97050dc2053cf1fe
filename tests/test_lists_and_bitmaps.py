"""Best values from sorted lists and numbers of values from bitmaps, beside sums over all days."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from hitloom.operators import panels
from hitloom.plans import distinct, ranking, rollups, tables
from hitloom.plans.tables import Tables

CUBE = "site_id int, datum date, dim string, parent string, dimkey string, pv long, v long"
DAILY = "site_id int, datum date, visits long, pageviews long, uniques long, bounces long, bytes long"
START = datetime.date(2024, 12, 1)
RANGES = [("2024-12-01", "2025-01-19"), ("2024-12-05", "2024-12-31"), ("2024-12-09", "2024-12-09"), ("2020-01-01", "2020-02-01")]


def cube_rows(seed, n_days=50, values=400, sites=(1, 2)):
    """Few values with most of the visits, many ties, zeros, empty keys, and one key under two parents."""
    draw = random.Random(seed)
    out = []
    for site in sites:
        for i in range(n_days):
            day = START + datetime.timedelta(days=i)
            out += [(site, day, "entry", None, f"/{x}", draw.randint(1, 9), 3000 // (x + 1) + draw.randint(0, 3)) for x in range(values) if x < 20 or draw.random() < 0.5]
            out += [(site, day, "download", None, f"/{x}.pdf", draw.randint(1, 3), 0) for x in draw.sample(range(40), 9)]
            out += [(site, day, "referrer_url", p, f"h{x}", 1, draw.randint(0, 2)) for p in ("A", "B") for x in draw.sample(range(12), 5)]
            out += [(site, day, "keyword", None, "", 5, 5), (site, day, "url", None, f"/u{i % 7}", 2, 1)]
    return out


def put(spark, store, rows):
    daily = sorted({(r[0], r[1], 1, 1, 1, 0, 0) for r in rows})
    tables.replace_days(store, spark.createDataFrame(rows, CUBE), spark.createDataFrame(daily, DAILY))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Lists of all days, of which ten were stored with other values before."""
    store = Tables(spark, str(tmp_path_factory.mktemp("lists")))
    put(spark, store, cube_rows(1))
    rollups.build(store)
    put(spark, store, [(*r[:4], r[4] and r[4] + "'", *r[5:]) for r in cube_rows(2, 10)])
    put(spark, store, cube_rows(3, 10))
    return store


@pytest.mark.parametrize("days", RANGES)
@pytest.mark.parametrize(("dim", "limit", "offset", "parent"), [("entry", 8, 0, None), ("entry", 100, 350, None), ("download", 5, 2, None), ("referrer_url", 10, 0, None), ("referrer_url", 4, 1, "B"), ("keyword", 5, 0, None)])
def test_exchange_gives_what_live_gives(store, days, dim, limit, offset, parent):
    metric = (panels.CHILD_METRIC if parent else panels.ROOT_METRIC)[dim]
    found = ranking.top_n_exchange(store, 1, *days, dim, limit, offset, parent)
    assert found.rows.collect() == panels.top_n_live(store.read("cube"), 1, *days, dim, metric, limit, offset, parent).collect()


def test_exchange_reads_few_rows(store):
    found = ranking.top_n_exchange(store, 1, *RANGES[0], "entry", 5)
    whole = panels.cube_slice(rollups.read_range(store, 1, *RANGES[0]), 1, *RANGES[0], "entry").count()
    lists = len(rollups.stored_cover(store, 1, *RANGES[0]))
    assert found.above < 0.1 * whole and found.candidates < 20 and found.heads <= panels.KEPT * lists


def test_many_candidates_are_joined(store, monkeypatch):
    monkeypatch.setattr(ranking, "LOOKED_UP", 3)
    got = ranking.top_n_exchange(store, 2, *RANGES[1], "entry", 50).rows.collect()
    assert got == panels.top_n_live(store.read("cube"), 2, *RANGES[1], "entry", "v", 50).collect()


def test_dimensions_without_lists_and_days_without_them(spark, store, tmp_path):
    with pytest.raises(ValueError, match="no lists"):
        ranking.top_n_exchange(store, 1, *RANGES[0], "url")
    bare = Tables(spark, str(tmp_path))
    put(spark, bare, cube_rows(1, 2, 5))
    for ask in (lambda: ranking.top_n_exchange(bare, 1, *RANGES[0], "entry"), lambda: distinct.stored_summary(bare, 1, *RANGES[0], "entry")):
        with pytest.raises(ValueError, match="build"):
            ask()


@pytest.mark.parametrize("days", RANGES)
def test_summaries(store, days):
    cube = store.read("cube")
    for dim, parent in (("entry", None), ("referrer_url", None), ("referrer_url", "A"), ("keyword", None), ("url", None), ("none", None)):
        assert distinct.stored_summary(store, 1, *days, dim, parent).collect() == panels.dim_summary(cube, 1, *days, dim, parent).collect()
    every = {r.dim: (r.pv, r.v, r.n) for r in distinct.stored_summaries(store, 1, *days).collect()}
    assert every == {d: tuple(r) for d in ("entry", "download", "referrer_url", "url") for r in panels.dim_summary(cube, 1, *days, d).collect() if r.n}


def test_numbers_stay_and_have_no_gaps(spark, store, monkeypatch):
    codes = store.read("codes")
    assert codes.count() == codes.select("site_id", "dim", "code").distinct().count() == codes.select("site_id", "dim", "dimkey").distinct().count()
    ends = codes.groupBy("site_id", "dim").agg(F.min("code").alias("a"), F.max("code").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.a == 1 and r.b == r.n for r in ends)
    monkeypatch.setattr(distinct, "SLOTS", 3)
    values = spark.createDataFrame([(1, "entry", f"new{i}") for i in range(50)] + [(1, "entry", "/1"), (9, "os", "x"), (9, "os", "x"), (9, "os", ""), (9, "os", None)], "site_id int, dim string, dimkey string")
    top = max(r.b for r in ends if r.site_id == 1 and r.dim == "entry")
    new = distinct.numbered(values, codes).collect()
    assert sorted(r.code for r in new if r.site_id == 1) == list(range(top + 1, top + 51))
    assert [(r.dimkey, r.code) for r in new if r.site_id == 9] == [("x", 1)]


def test_numbers_beyond_one_bitmap(spark):
    rows = spark.range(70_000).selectExpr("1 AS site_id", "DATE '2025-01-01' AS datum", "'entry' AS dim", "CAST(NULL AS STRING) AS parent", "CAST(id AS STRING) AS dimkey", "1L AS pv", "1L AS v")
    none = spark.createDataFrame([], "site_id int, dim string, dimkey string, code bigint")
    twice = rows.unionByName(rows.where("dimkey < 5").withColumn("datum", F.lit("2025-01-02").cast("date")))
    bitmaps = distinct.day_bitmaps(twice, distinct.numbered(twice, none))
    assert bitmaps.select("bucket").distinct().count() == 3
    assert distinct._united(bitmaps, "dim").first().n == 70_000


def test_purged_days_go(spark, tmp_path):
    store = Tables(spark, str(tmp_path))
    put(spark, store, cube_rows(4, 40, 30, (1,)))
    rollups.build(store)
    tables.purge(store, 1, "2025-01-20")
    days = ("2024-12-01", "2025-02-01")
    assert min(d for _, d in store.partitions("bitmaps")) == datetime.date(2024, 12, 20)
    assert distinct.stored_summary(store, 1, *days, "entry").collect() == panels.dim_summary(store.read("cube"), 1, *days, "entry").collect()
    assert ranking.top_n_exchange(store, 1, *days, "entry").rows.collect() == panels.top_n_live(store.read("cube"), 1, *days, "entry").collect()
