"""Visits of hot visitors, first matching patterns and narrowest ranges, each beside a slow form."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hitloom.operators import agents, geo
from hitloom.operators.sessions import sessionize

# --- visits ---------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 60, 3600, 86_400])
def test_slices_change_no_visit(spark, width):
    """One visitor with most of the hits, pauses of just the gap, ties, and instants at the ends of slices."""
    draw, at, rows = random.Random(width), 0, []
    for i in range(3000):
        at += draw.choice([0, 0, 1, 59, 600, 1799, 1800, 1801, 3600, 7200])
        rows.append((1, "hot" if i % 4 else f"v{i % 7}", at, i))
    rows += [(None, "hot", 3600 * n, 9000 + n) for n in range(5)] + [(1, None, 1800 * n, 9100 + n) for n in range(5)] + [(1, "hot", None, 9200), (1, "late", None, 9201)]
    hits = spark.createDataFrame(rows, "site_id int, vkey string, s long, rid long").withColumn("ts", F.timestamp_seconds("s")).repartition(7)
    plain, sliced = (sessionize(hits, slice_seconds=w) for w in (None, width))
    assert plain.columns == sliced.columns
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, sliced.collect()))


def test_hot_visitor_fills_no_task(spark):
    rows = spark.range(50_000).select(F.lit(1).alias("site_id"), F.lit("hot").alias("vkey"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.col("id").alias("rid"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = sessionize(rows).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in held) == 50_000 and max(r["count"] for r in held) < 20_000


# --- patterns -------------------------------------------------------------------

WORDS = ["Chrome", "Firefox", "Edg", "Safari", "Opera", "Mobile", "Linux", "Gecko", "Version", "Trident", "MSIE", "K-Meleon", "X11", "UCBrowser", "İris", "ſafari"]


@pytest.mark.parametrize("regex, grams", [
    (r"Firefox/(\d+)", ["ref"]),
    (r"Edg[ea]?/(\d+)", ["edg"]),
    (r"(?:Chrome|CrMo|CriOS)(?:/(\d+))?", ["rio", "rmo", "rom"]),
    (r"X11", ["x11"]),
    (r"\d+\.\d+", None),
    (r"(?:abc)?x", None),
    (r"(?:abc|d)", None),
    (r"(?:abc)+", ["abc"]),
    (r"a(?:bc)d", ["abc"]),
    (r"abc?", None),
    (r"(?=abc)x", None),
    (r"\Qabc\E", None),
    (r"[a&&[^b]]foo", None),
    (r"ÄBCD", ["bcd"]),
    (r"(?i)OPERA", ["per"]),
    (r"Foo|", None),
])
def test_required_grams(regex, grams):
    assert agents.required_grams(regex) == grams


def slow_first(uas, patterns):
    out = {}
    for ua in {u for u in uas if u not in (None, "", "-")}:
        met = [p for p in patterns if re.search(r"(?i)(?a)(?:^|[^A-Z0-9_-]|[^A-Z0-9-]_|sprd-|MZ-)(?:" + p[1] + ")", ua, re.ASCII)]
        if met:
            best = min(met, key=lambda p: (p[0], p[1]))
            out[ua] = best[2]
    return out


def test_first_patterns_among_candidates(spark):
    draw = random.Random(3)
    patterns = [(n % 40, draw.choice([f"{w}/(\\d+)", f"{w}", f"(?:{w}|{draw.choice(WORDS)})[ /]?(\\d*)", f"{w} .* {draw.choice(WORDS)}", f"{w[:3]}"]), f"name{n}", "$1") for n, w in enumerate(draw.choices(WORDS, k=150))]
    patterns += [(90, r"\d\d\d\d", "digits", ""), (91, r"z", "z", ""), (None, "no prio", "x", ""), (5, None, "no regex", "")]
    uas = [" ".join(draw.choice(WORDS).swapcase() + draw.choice(["", f"/{draw.randint(0, 9999)}", "; "]) for _ in range(draw.randint(1, 5))) for _ in range(200)]
    uas += [None, "", "-", "z", "  ", "Firefox/" + "9" * 3000, "日本 Chrome/7"]
    hits = spark.createDataFrame([(u,) for u in uas], "ua string")
    listed = spark.createDataFrame(patterns, "prio int, regex string, name string, version string")
    sound = [p for p in patterns if p[1] is not None]
    found = agents._first_match(hits.distinct(), listed, "browser", "v")
    want = slow_first(uas, [(-1 if p[0] is None else p[0], *p[1:]) for p in sound])  # a null comes first
    assert {r.ua: r.browser for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    met = agents.pattern_candidates(hits.where("ua is not null").distinct(), listed)
    pairs = len({u for u in uas if u is not None}) * len(sound)
    assert met.count() < 0.5 * pairs and met.count() == met.distinct().count()


# --- ranges ---------------------------------------------------------------------


def slow_country(addresses, ranges):
    out = {}
    for a in {x for x in addresses if x is not None and 0 <= x < 1 << 32}:
        met = [(e - s, s, cc is not None, cc or "") for s, e, cc in ranges if s is not None and e is not None and s <= a <= e]
        if met:
            best = min(met)
            out[a] = best[3] if best[2] else None
    return out


def test_narrowest_ranges(spark):
    draw = random.Random(9)
    ranges = [(0, (1 << 32) - 1, "WW"), (8 << 24, (9 << 24) - 1, "US"), (-5, 3, "LO"), ((1 << 32) - 2, 1 << 40, "HI"), (7, 6, "??"), (None, 5, "NU"), (5, None, "NU"), (20, 30, None), (20, 30, "AA"), (20, 30, "BB"), (25, 35, "CC")]
    for _ in range(400):  # a /8 crowded with small, nested and overlapping ranges, many of one width
        start = (8 << 24) + draw.randrange(0, 1 << 14) * 16
        ranges.append((start, start + draw.choice([0, 15, 15, 255, 300, 4095, 70_000]), draw.choice("ABCDEF") * 2))
    for _ in range(60):
        start = draw.randrange(0, 1 << 32)
        ranges.append((start, start + draw.randrange(0, 1 << 28), draw.choice("GHIJ") * 2))
    addresses = [None, -1, 1 << 32, 0, 3, 4, (1 << 32) - 1, *range(15, 40)] + [(8 << 24) + draw.randrange(0, 1 << 18) for _ in range(1500)] + [draw.randrange(0, 1 << 32) for _ in range(500)]
    rows = spark.createDataFrame(ranges, "start bigint, end bigint, cc string")
    hits = spark.createDataFrame([(a,) for a in addresses], "ipint bigint")
    found = geo.ip_country(hits, rows)
    assert {r.ipint: r.cc for r in found.collect()} == slow_country(addresses, ranges)
    assert found.count() == found.select("ipint").distinct().count()
    pieces = sorted((r.start, r.end) for r in geo.disjoint_ranges(rows).collect())
    assert all(a[1] < b[0] for a, b in zip(pieces, pieces[1:]))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert geo.ip_country(hits, rows.limit(0)).count() == 0 and geo.ip_country(hits.limit(0), rows).count() == 0
