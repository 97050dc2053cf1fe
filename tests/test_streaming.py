"""Streams against their batch twins, and the incremental import."""

import datetime
import gzip
import json

import pytest
from pyspark.sql import functions as F

from hitloom.plans.importing import ImportConfig, import_sites, parsed_hits
from hitloom.plans.tables import Tables
from hitloom.sources import growing
from hitloom.sources.growing import read_log_files, stream_log_files
from hitloom.sources.lines import read_lines
from hitloom.streaming import streams

UA = "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0"


def line(day, time, ip="1.2.3.4", url="/a"):
    return f'{ip} - - [{day:02}/Jan/2026:{time} +0000] "GET {url} HTTP/1.1" 200 10 "-" "{UA}"'


def drop(folder, name, *texts):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(texts) + "\n")


def run(df, mode, name):
    # Until idle: the batch without data that lets visits out comes after the last one with data.
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()


def test_sessions_and_buckets(spark, tmp_path):
    texts = [line(10, t) for t in ("10:00:00", "10:30:00", "11:00:01", "12:00:00")] + [line(10, "10:05:00", "5.5.5.5")]
    drop(tmp_path / "in", "1.log", *texts)
    drop(tmp_path / "in", "2.log", line(11, "10:00:00", "9.9.9.9"))
    found = streams.stream_hits(spark, str(tmp_path / "in"), ImportConfig(salt="s"))
    run(streams.stream_sessions(found), "append", "visits_out")
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "site_id int, rid long, line string")
    batch = import_sites(lines, ImportConfig(salt="s")).visits
    # The visit that the watermark has not passed waits: here that of the last line alone.
    out = spark.table("visits_out")
    assert sorted(r.pageviews for r in out.collect()) == sorted(r.pageviews for r in batch.collect()) == [1, 1, 1, 2]
    assert {r.vkey for r in out.collect()} == {r.vkey for r in batch.collect()}
    run(streams.stream_buckets(found, "Europe/Berlin", "1 day"), "complete", "days_out")
    assert {str(r.bucket): r.pageviews for r in spark.table("days_out").collect()} == {"2026-01-10 00:00:00": 5, "2026-01-11 00:00:00": 1}


def test_days_to_build(spark):
    built = lambda *days: spark.createDataFrame([(datetime.date(2026, 1, d),) for d in days], "datum date")
    todo = lambda b: sorted(r.datum.day for r in streams.days_to_build(b, "2026-01-10", 3).collect())
    assert todo(built()) == [7, 8, 9]
    assert todo(built(5, 6)) == [7, 8, 9]
    assert todo(built(8, 9)) == [9]


def test_import(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "store"))
    source, limit = tmp_path / "in", ["2026-01-11"]

    def go():
        lines = streams.stream_lines(spark, str(source), 3)
        query = streams.start_import(lines, tables, str(tmp_path / "checkpoint"), lambda: limit[0], ImportConfig(salt="s"))
        query.awaitTermination(180)
        assert query.exception() is None
        return {r.datum.day: (r.visits, r.pageviews) for r in tables.read("daily").collect()}

    drop(source, "1.log", line(9, "23:50:00"), line(10, "10:00:00"), line(11, "01:00:00"))
    assert go() == {9: (1, 1), 10: (1, 1)}  # the running day waits
    drop(source, "2.log", line(10, "10:10:00", url="/b"))  # a late line changes its whole day
    assert go() == {9: (1, 1), 10: (1, 2)}
    limit[0] = "2026-01-12"
    drop(source, "3.log", line(11, "01:10:00"))
    assert go() == {9: (1, 1), 10: (1, 2), 11: (1, 2)}
    assert go() == {9: (1, 1), 10: (1, 2), 11: (1, 2)}  # nothing new
    meta = tables.read("meta").first()
    assert (meta.von, meta.bis, meta.pageviews_total) == ("2026-01-09", "2026-01-11", 5)
    assert tables.read("topn").where("dim = 'entry' AND win = 'all'").count() > 0


@pytest.fixture
def importing(spark, tmp_path):
    """Imports what the files of each site have grown by; gives the page views of (site, day)."""
    tables = Tables(spark, str(tmp_path / "store"))

    def go(sites, checkpoint="checkpoint", limit="2026-01-20", split=1 << 20):
        lines = stream_log_files(spark, {s: str(p) for s, p in sites.items()}, split)
        query = streams.start_import(lines, tables, str(tmp_path / checkpoint), lambda: limit, ImportConfig(salt="s"))
        query.awaitTermination(180)
        assert query.exception() is None
        return {(r.site_id, r.datum.day): r.pageviews for r in tables.read("daily").collect()}

    return go


def append(path, *texts, end="\n"):
    with open(path, "a") as file:
        file.write("\n".join(texts) + end)


def test_appended_and_rotated_files(importing, tmp_path):
    log, old = tmp_path / "access.log", tmp_path / "access.log.1"
    site = {1: f"{tmp_path}/access.log*"}
    append(log, line(9, "10:00:00"), line(9, "10:01:00", url="/b"))
    assert importing(site) == {(1, 9): 2}
    append(log, line(9, "10:02:00"), line(9, "10:03:00"), end="")  # the last line is not whole yet
    assert importing(site) == {(1, 9): 3}
    append(log, "", line(9, "10:04:00"))
    assert importing(site, split=40) == {(1, 9): 5}
    append(log, line(9, "10:05:00"))
    log.rename(old)  # with a line that was not read before
    append(log, line(9, "10:06:00"), line(9, "10:07:00"))
    assert importing(site) == {(1, 9): 8}
    assert importing(site) == {(1, 9): 8}
    with open(log, "w"):  # emptied in place, then longer than before
        pass
    append(log, *[line(10, f"11:{m:02}:00") for m in range(9)])
    assert importing(site) == {(1, 9): 8, (1, 10): 9}


def test_two_streams_and_a_new_checkpoint_lose_nothing(importing, tmp_path):
    one, two = tmp_path / "one.log", tmp_path / "two.log"
    append(one, *[line(9, f"10:0{m}:00") for m in range(5)])
    append(two, line(9, "10:00:00"))
    assert importing({1: one}, "a") == {(1, 9): 5}
    assert importing({2: two}, "b") == {(1, 9): 5, (2, 9): 1}
    append(one, line(9, "10:09:00"))  # late: its day is built again from all lines
    assert importing({1: one}, "a") == {(1, 9): 6, (2, 9): 1}
    # A lost checkpoint: all is read again, beside what the old one landed, and counts once.
    append(one, line(9, "10:09:00"))  # the same text at another place is another hit
    assert importing({1: one}, "c") == {(1, 9): 7, (2, 9): 1}
    append(one, line(9, "10:30:00"))
    assert importing({1: one, 2: two}, "d") == {(1, 9): 8, (2, 9): 1}


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_places_do_not_depend_on_splits(spark, tmp_path, split):
    texts = ["a", "", "bb\r", "ccc ä", "x" * 300, "last"]
    (tmp_path / "log").write_bytes("\n".join(texts).encode() + b"\n\xff\xfe")
    with gzip.open(tmp_path / "old.gz", "wt") as file:
        file.write("one\ntwo\n")
    rows = read_log_files(spark, {4: f"{tmp_path}/log", 5: f"{tmp_path}/*.gz", 6: f"{tmp_path}/none"}, split).orderBy("site_id", "rid").collect()
    want = [(4, 0, "a"), (4, 3, "bb"), (4, 7, "ccc ä"), (4, 14, "x" * 300), (4, 315, "last"), (4, 320, "��"), (5, 0, "one"), (5, 4, "two")]
    assert [(r.site_id, r.byte, r.line) for r in rows] == want


def test_order_of_spark_read_lines(spark, tmp_path):
    """Splits of one file may be read in any order and by any task; the order of lines stays."""
    (tmp_path / "log").write_text("".join(f"line {i}\n" for i in range(2000)))
    for size in ("300", "4k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            rows = read_lines(spark, str(tmp_path / "log")).orderBy("rid").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [r.line for r in rows] == [f"line {i}" for i in range(2000)]


def test_renamed_while_it_is_read(tmp_path):
    log = tmp_path / "log"
    append(log, "first", "second")
    source = growing.GrowingFiles({"sites": json.dumps([[1, f"{tmp_path}/log*"]])})
    part = source.partitions(source.initialOffset(), source.latestOffset())[0]
    log.rename(tmp_path / "log.1")
    append(log, "third")
    assert [x for b in growing.read_stretch(part) for x in b.column(4).to_pylist()] == ["first", "second"]
    (tmp_path / "log.1").unlink()
    with pytest.raises(FileNotFoundError, match="is gone"):
        list(growing.read_stretch(part))


def test_only_mounted_folders_grow():
    assert growing.mounted("file:///a/b") == growing.mounted("/a/b") == "/a/b"
    with pytest.raises(ValueError, match="mounted"):
        growing.mounted("s3a://logs/a")


def test_new_files_of_a_store(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "store"))
    for name, texts in (("1.log", [line(9, "10:00:00")] * 2), ("2.log", [line(9, "10:01:00")])):
        drop(tmp_path / "in", name, *texts)
        lines = streams.stream_new_files(spark, str(tmp_path / "in"), 3)
        streams.start_import(lines, tables, str(tmp_path / "checkpoint"), lambda: "2026-01-11").awaitTermination(180)
    assert [(r.site_id, r.pageviews) for r in tables.read("daily").collect()] == [(3, 3)]


def test_day_of_failed_requests_is_built_once(spark, tmp_path, monkeypatch):
    tables, source, built = Tables(spark, str(tmp_path / "store")), tmp_path / "in", []

    def seen(lines, config):
        built.append(lines.inputFiles())
        return import_sites(lines, config)

    monkeypatch.setattr(streams, "import_sites", seen)
    for name, text in (("1.log", line(9, "10:00:00").replace('" 200 ', '" 404 ')), ("2.log", line(12, "10:00:00"))):
        drop(source, name, text)
        streams.start_import(streams.stream_lines(spark, str(source), 3), tables, str(tmp_path / "checkpoint"), lambda: "2026-01-11").awaitTermination(180)
    assert len(built) == 1 and all("site_id=3/datum=2026-01-09" in f for f in built[0])  # the second batch holds only the running day


def test_identical_lines_all_count(spark):
    lines = spark.createDataFrame([(1, 7, line(10, "10:00:00"))] * 2, "site_id int, rid long, line string")
    assert parsed_hits(lines, ImportConfig()).count() == 2
    assert import_sites(lines).daily().first().pageviews == 2


@pytest.mark.parametrize("gap, visits", [("30 minutes", 2), ("2 hours", 1)])
def test_session_window_gap(spark, gap, visits):
    rows = spark.createDataFrame([("v", 0), ("v", 1800), ("v", 3601)], "vkey string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert rows.groupBy(F.session_window("ts", gap), "vkey").count().count() == visits


def test_small_splits_of_large_files_are_few_tasks(tmp_path):
    (tmp_path / "log").write_text("".join(f"line {i}\n" for i in range(20_000)))
    source = growing.WholeFiles({"sites": json.dumps([[1, f"{tmp_path}/log"]]), "split": "50"})
    assert len(source.partitions()) <= growing.MOST_SPLITS
    grown = growing.GrowingFiles({"sites": json.dumps([[1, f"{tmp_path}/log"]]), "split": "50"})
    assert len(grown.partitions(grown.initialOffset(), grown.latestOffset())) <= growing.MOST_SPLITS
    assert [x for p in source.partitions() for b in growing.read_stretch(p) for x in b.column(4).to_pylist()] == [f"line {i}" for i in range(20_000)]


def test_a_site_is_written_by_many_tasks_in_order(spark, tmp_path):
    rows = spark.range(3000).selectExpr("1 AS site_id", "id AS rid", "concat('line ', id) AS line").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = growing.write_log_files(rows, f"{tmp_path}/parts")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert list(parts) == [("1",)] and len(parts["1",]) == 4
    target = f"{tmp_path}/log"
    for times in (1, 2):  # the second time it is appended
        growing.join_files(spark, {target: parts["1",]})
        with open(target) as file:
            assert file.read() == "".join(f"line {i}\n" for i in range(3000)) * times
