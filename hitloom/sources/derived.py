"""A web log derived from a table of events, for queries and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the derived log says for each remainder; any text would do that the classification knows.
REFERRERS = (
    "https://duckduckgo.com/?q=garden+hose+",
    None,
    "http://www.linkedin.com/feed/",
    "https://old.example.net:8080/links.html",
    "https://www.ecosia.org/search",
    "https://x.com/someone/status/77",
)
AGENTS = (
    "Mozilla/5.0 (Windows NT 6.3; WOW64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/109.0.5414.75 Safari/537.36 Edg/109.0.1518.61",
    "Mozilla/5.0 (Android 12; Mobile; rv:112.0) Gecko/112.0 Firefox/112.0",
    "AcmeHarvester/2.7 (crawler; +https://harvest.example/about)",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/108.0.5359.124 Safari/537.36",
    "Mozilla/5.0 (Linux; Android 11; Pixel 4a) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/99.0.4844.58 Mobile Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 15_6_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/15.6.1 Mobile/19G82 Safari/604.1",
)
STYLE_SHEET = "/theme/site.css"
#: Twenty neighbouring users are one visitor.
VISITOR = "user_id div 20"


def derived_log(events: DataFrame, *more: str) -> DataFrame:
    """(site_id, rid, line): one line in the combined format for each event; ``more`` columns of the events stay.

    Twenty neighbouring users are one visitor, so visits have several hits; two sites share them.
    """
    e, v = F.col("event_id"), F.col("v")
    text = lambda c: c.cast("string")
    ip4 = F.concat_ws(".", text(8 + v % 3), F.lit("8"), text(v % 256), text(1 + v % 200))
    ip = F.when(v % 7 == 6, F.concat(F.lit("2001:db8::"), text(v % 1000))).otherwise(ip4)
    kind = F.col("event_type")
    url = (
        F.when(e % 11 == 0, F.lit(STYLE_SHEET))
        .when(kind == "view", F.concat_ws("/", F.lit("/p"), text(e % 13), text(e % 4)))
        .when(kind == "click", F.concat_ws("/", F.lit("/p"), text(e % 5)))
        .when(kind == "signup", F.lit("/signup/?x=1"))
        .when(kind == "purchase", F.concat(F.lit("/docs/f"), text(e % 9), F.lit(".pdf?dl=1")))
        .otherwise(F.concat(F.lit("/gone/"), text(e % 3)))
    )
    status = F.when(kind == "error", F.when(e % 2 == 0, 404).otherwise(500)).otherwise(200)
    referrer = F.get(F.array(*[F.lit(r or "-") for r in REFERRERS]), (e % 6).cast("int"))
    referrer = F.when(e % 6 == 0, F.concat(referrer, text(e % 10))).otherwise(referrer)
    agent = F.get(F.array(*[F.lit(a) for a in AGENTS]), (v % 6).cast("int"))
    time = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    method = F.when(kind == "purchase", F.lit("POST")).otherwise(F.lit("GET"))
    size = text(F.floor(F.col("value") * 100).cast("long"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    request = quoted(F.concat_ws(" ", method, url, F.lit("HTTP/1.1")))
    line = F.concat_ws(" ", ip, F.lit("- -"), F.concat(F.lit("["), time, F.lit(" +0000]")), request, text(status), size, quoted(referrer), quoted(agent))
    rows = events.withColumn("v", F.expr(VISITOR))
    return rows.select((v % 2).cast("int").alias("site_id"), e.alias("rid"), line.alias("line"), *more)


def dealt_events(events: DataFrame) -> DataFrame:
    """Events dealt by ranges of the site and place that their lines will have.  Ranges are found by a pass over a sample of
    what is dealt: of narrow events, where lines would all be made for it and then made again."""
    site = F.pmod(F.expr(VISITOR), F.lit(2))
    return events.repartitionByRange(site, "event_id")


def geo_rows() -> list[tuple[int, int, str]]:
    """Ranges around the derived addresses; one lies within another."""
    return [(n * 2**24 + 8 * 2**16, n * 2**24 + 8 * 2**16 + 65535, cc) for n, cc in ((8, "US"), (9, "AU"), (10, "FR"))] + [
        (8 * 2**24 + 8 * 2**16, 8 * 2**24 + 8 * 2**16 + 255, "DE")
    ]


def geo6_rows() -> list[tuple[str, str, str]]:
    return [("20010db8" + "0" * 24, "20010db8" + "f" * 24, "DE"), ("2a00" + "0" * 28, "2a00" + "f" * 28, "FR")]
