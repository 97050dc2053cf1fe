"""Golden numbers of a nine-line log, in every format and with every list."""

import ipaddress
import json

import pytest
from pyspark.sql import functions as F

from hitloom.functions.network import ip6_hex
from hitloom.operators import geo as geo_joins
from hitloom.operators import hits
from hitloom.plans.importing import ImportConfig, import_sites, parsed_hits
from hitloom.sources import geo, lines, lists

CHROME = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36"
EDGE = CHROME + " Edg/120.0.2210.91"
GOOGLEBOT = "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)"
REQUESTS = [
    ("8.8.8.8", "10:00:00", "/a", 200, 1000, "https://www.google.com/search?q=test+begriff", CHROME),
    ("8.8.8.8", "10:05:00", "/b", 200, 1500, "-", CHROME),
    ("8.8.8.8", "10:10:00", "/c.pdf", 200, 2000, "-", CHROME),
    ("8.8.8.8", "11:00:00", "/a", 200, 1000, "-", CHROME),
    ("1.1.1.1", "10:30:00", "/a", 200, 1200, "-", CHROME),
    ("8.8.8.8", "10:31:00", "/style.css", 200, 300, "-", CHROME),
    ("8.8.8.8", "10:32:00", "/missing", 404, 0, "-", CHROME),
    ("66.249.66.1", "12:00:00", "/a", 200, 5000, "-", GOOGLEBOT),
    ("2001:db8::1", "13:00:00", "/a", 200, 500, "-", EDGE),
]
LINES = [f'{ip} - - [10/Jan/2026:{t} +0000] "GET {u} HTTP/1.1" {s} {n} "{r}" "{ua}"' for ip, t, u, s, n, r, ua in REQUESTS]
GEO = [(134744064, 134744319, "US"), (16842752, 16908287, "AU")]


def frame(spark, texts, site=1):
    return spark.createDataFrame([(site, i, t) for i, t in enumerate(texts)], "site_id int, rid long, line string")


def config(spark, **more):
    more = {"salt": "s", "geo": spark.createDataFrame(GEO, "start long, end long, cc string")} | more
    return ImportConfig(**more)


def cells(analysis):
    return {(r.dim, r.parent, r.dimkey): (r.pv, r.v) for r in analysis.cube().collect()}


def test_golden_numbers(spark):
    found = import_sites(frame(spark, LINES), config(spark))
    (day,) = found.daily().collect()
    assert (day.pageviews, day.visits, day.uniques, day.bounces, day.bytes) == (6, 4, 3, 3, 7200)
    cube = cells(found)
    assert cube["url", None, "/a"][0] == 4 and cube["url", None, "/b"][0] == 1
    assert cube["entry", None, "/a"][1] == 4 and cube["exit", None, "/c.pdf"][1] == 1
    assert cube["referrer_type", None, "search"][1] == 1 and cube["referrer_type", None, "direct"][1] == 3
    assert cube["referrer_name", "search", "Google"][1] == 1
    assert cube["keyword", None, "test begriff"][1] == 1
    assert cube["browser", None, "Chrome"][1] == 3 and cube["browser", None, "Edge"][1] == 1
    assert ("browser", None, "Andere") not in cube
    assert cube["browser_version", "Edge", "Edge 120.0.2210.91"][1] == 1
    assert cube["os", None, "Windows"][1] == 4 and cube["device", None, "Desktop"][1] == 4
    assert cube["method", None, "GET"][0] == 6
    assert cube["country", None, "US"][1] == 2 and cube["country", None, "AU"][1] == 1 and cube["country", None, "??"][1] == 1
    assert [k for k in cube if k[0] == "download"] == [("download", None, "/c.pdf")]
    assert cube["status", None, "404"][0] == 1 and cube["status", None, "200"][0] == 6
    assert not any("style.css" in k[2] or "\x1f" in k[2] for k in cube)
    assert sum(v for (d, _, _), (_, v) in cube.items() if d == "country") == day.visits
    (total,) = found.totals().collect()
    assert (total.visits_total, total.pageviews_total, total.uniques_total, total.bounces_total, total.bytes_total) == (4, 6, 3, 3, 7200)


def test_vhost_lines_give_the_same_cube(spark):
    plain = cells(import_sites(frame(spark, LINES), config(spark)))
    vhost = import_sites(frame(spark, ["www.example.org:443 " + x for x in LINES]), config(spark, fmt="combined_vhost"))
    assert cells(vhost) == plain


def test_common_lines_have_no_agent(spark):
    texts = [x.split(' "-"')[0].split(' "https')[0] for x in LINES]
    found = import_sites(frame(spark, texts), config(spark, fmt="common"))
    # Without user agents the crawler counts, and all of them are one browser.
    assert found.daily().first().pageviews == 7
    assert {k[2] for k in cells(found) if k[0] == "browser"} == {"Andere"}


def test_ip6_ranges(spark):
    ranges = spark.createDataFrame([("20010db8" + "0" * 24, "20010db8" + "f" * 24, "DE")], "start_hex string, end_hex string, cc string")
    cube = cells(import_sites(frame(spark, LINES), config(spark, geo6=ranges)))
    assert cube["country", None, "DE"][1] == 1 and ("country", None, "??") not in cube


def test_bot_list(spark, tmp_path):
    (tmp_path / "bots").write_text("# list\n\nAcmeHarvester/[0-9.]+\nGooglebot\n")
    pattern = lists.read_bot_list(spark, str(tmp_path / "bots"))
    extra = LINES[1].replace(CHROME, "AcmeHarvester/1.0").replace("8.8.8.8", "9.9.9.9")
    count = lambda **more: import_sites(frame(spark, [*LINES, extra]), config(spark, **more)).daily().first().pageviews
    assert count(bot_pattern=pattern) == 6 and count() == 7
    (tmp_path / "none").write_text("#\n")
    with pytest.raises(ValueError):
        lists.read_bot_list(spark, str(tmp_path / "none"))


def test_agent_lists(spark, tmp_path):
    (tmp_path / "browsers").write_text("1\tEdg[ea]?/(\\d+)\tTestEdge\t$1\n2\t#x\tno\t\n")
    (tmp_path / "systems").write_text("1\tWindows NT (\\d+\\.\\d+)\tTestWindows\t$1\n")
    tables = [lists.read_ua_list(spark, str(tmp_path / n)) for n in ("browsers", "systems")]
    assert tables[0].count() == 1
    cube = cells(import_sites(frame(spark, LINES), config(spark, browsers=tables[0], oses=tables[1])))
    assert cube["browser", None, "Chrome"][1] == 3 and cube["browser", None, "TestEdge"][1] == 1
    assert cube["os", None, "TestWindows"][1] == 4 and cube["os_version", "TestWindows", "TestWindows 10.0"][1] == 4


def test_json_lines(spark):
    def line(time, ip="1.2.3.4", **more):
        return json.dumps({
            "@timestamp": time, "client": {"ip": ip}, "http": {"request": {"method": "GET"}, "response": {"status_code": "200", "bytes": "5"}},
            "HTTP": {"url_path": "/x", "req": {"referer": "-"}}, "user_agent": {"original": CHROME}, **more,
        })

    mixed = [line("2026-07-14T12:00:00+02:00"), "2026/07/14 [error] upstream timed out", '{"half": ', line("2026-07-14T12:00:01+02:00")]
    rows = lines.parse_lines(frame(spark, mixed), "json_ecs").collect()
    assert len(rows) == 2 and rows[0].url == "/x" and rows[0].method == "GET"
    days = [line(f"2026-07-{t}+02:00") for t in ("13T23:59:59", "14T12:00:00", "15T00:00:01")]
    kept = lambda **more: parsed_hits(frame(spark, days), config(spark, fmt="json_ecs", tz="Europe/Berlin", **more)).count()
    assert kept(day_from="2026-07-14", day_to="2026-07-14") == 1 and kept() == 3


def test_day_cut(spark):
    texts = [LINES[0].replace("10/Jan", f"{d}/Jan") for d in (10, 10, 11, 11)]
    kept = lambda day: parsed_hits(frame(spark, texts), config(spark, cutoff=day)).count()
    assert [kept(f"2026-01-{d}") for d in (11, 10, 12)] == [2, 0, 4]


def test_custom_format_is_checked(spark):
    with pytest.raises(ValueError):
        lines.log_format("custom", r"(\d+)", "%Y")
    with pytest.raises(ValueError):
        lines.log_format("apache")
    assert lines.count_groups(r"(a)(?:b)[(](?<n>c)\((?=d)") == 2


def test_half_hour_gap(spark):
    start = "2026-01-10 10:00:00"
    rows = spark.createDataFrame([(1, "v", 0, 0), (1, "v", 1, 1800), (1, "v", 2, 3601)], "site_id int, vkey string, rid long, s long")
    rows = rows.withColumn("ts", F.timestamp_seconds(F.unix_seconds(F.lit(start).cast("timestamp")) + F.col("s")))
    from hitloom.operators.sessions import sessionize

    assert [r.seq for r in sessionize(rows).orderBy("rid").collect()] == [1, 1, 2]


def test_first_known_attribute_counts(spark):
    later = LINES[1].replace('"-"', '"https://www.bing.com/?q=two"')
    found = import_sites(frame(spark, [LINES[1].replace("10:05", "10:01"), later]), config(spark))
    (visit,) = found.visits.collect()
    assert visit.referrer == "-" and visit.keyword == "two"


def test_days_follow_the_local_clock(spark):
    text = LINES[0].replace("10/Jan/2026:10:00:00 +0000", "29/Mar/2026:22:30:00 +0000")
    row = hits.with_times(lines.parse_lines(frame(spark, [text])), tz="Europe/Berlin").first()
    assert str(row.datum) == "2026-03-30" and row.stunde == 0


def test_read_lines_and_sites(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join(["a\tb", "", "c"]))
    rows = lines.read_lines(spark, str(tmp_path / "log")).collect()
    assert [(r.line, r.nbytes) for r in rows] == [("a\tb", 4), ("c", 2)]
    (tmp_path / "sites").write_text("# id\tfile\tname\n\n1\t/logs/a.log\tSite A\n2\t/logs/b.log\tSite B\n")
    assert [tuple(r) for r in lines.read_sites(spark, str(tmp_path / "sites")).collect()] == [(1, "/logs/a.log", "Site A"), (2, "/logs/b.log", "Site B")]


def test_geo_sources(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    want = [(16777216, 16777471, "AU")]
    rows = lambda *a: [tuple(r) for r in geo.read_geo(spark, *a).collect()]
    assert rows("native", write("n", "16777216,16777471,AU\n")) == want
    assert rows("ip2location", write("i", '"16777216","16777471","AU","Australia"\n')) == want
    assert rows("dbip", write("d", "1.0.0.0,1.0.0.255,AU\n2001:db8::,2001:db8::ff,DE\n")) == want
    blocks = write("b", "network,geoname_id,registered_country_geoname_id,x\n1.0.0.0/24,,7,\n2001::/32,7,7,\n9.0.0.0/8,99,,\n")
    places = write("p", "geoname_id,locale_code,continent_code,continent_name,country_iso_code,country_name\n7,en,OC,Oceania,AU,Australia\n")
    assert rows("maxmind", blocks, places) == want
    six = geo.read_geo6(spark, write("6", "1.0.0.0,1.0.0.255,AU\n2001:db8::,2001:db8::ff,DE\nbad:,x,FR\n")).collect()
    assert [(r.start_hex, r.cc) for r in six] == [("20010db8" + "0" * 24, "DE")]
    with pytest.raises(ValueError):
        geo.read_geo(spark, "other", "x")


def test_ip6_hex(spark):
    rows = spark.createDataFrame([("::1",), ("2001:DB8::1",), ("1.2.3.4",), ("no:good",), (None,)], "ip string")
    assert [r.h for r in rows.select(ip6_hex(F.col("ip")).alias("h")).collect()] == ["0" * 31 + "1", "20010db8" + "0" * 23 + "1", None, None, None]


def test_lines_of_no_format_fall_out(spark):
    texts = ["", "garbage", LINES[0].replace("10/Jan", "99/Jan"), LINES[0].replace(" 200 1000 ", " 200 - ")]
    assert parsed_hits(frame(spark, texts), config(spark)).count() == 0


def test_ip6_ranges_against_all_pairs(spark):
    digits = lambda n: f"{n:032x}"
    base = int("20010db8" + "0" * 24, 16)
    edges = [
        (0, (1 << 128) - 1, "A"), (base, base + (1 << 96) - 1, "B"), (base + 5, base + 5, "C"), (base + 0xF0, base + 0x110, "D"),
        (base + 0x100, base + 0x1FF, "E"), (base + (1 << 96) - 3, base + (1 << 96) + 3, "F"), (base + 9, base + 2, "never"),
    ]
    ranges = spark.createDataFrame([(digits(a), digits(b), c) for a, b, c in edges], "start_hex string, end_hex string, cc string")
    numbers = sorted({max(0, min((1 << 128) - 1, x + d)) for a, b, _ in edges for x in (a, b) for d in (-1, 0, 1)})
    hits = spark.createDataFrame([(str(ipaddress.IPv6Address(n)),) for n in numbers] * 2 + [("1.2.3.4",), ("::bad::",), (None,)], "ip string")
    found = {r.ip: r.cc for r in geo_joins.ip6_country(hits, ranges).collect()}
    assert found == {str(ipaddress.IPv6Address(n)): max((a, c) for a, b, c in edges if a <= n <= b)[1] for n in numbers}
    assert geo_joins.ip6_country(hits, ranges.limit(0)).count() == 0
