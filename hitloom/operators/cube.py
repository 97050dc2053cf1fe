"""The daily sums and the cube (site, day, dimension, parent, value) -> page views and visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUBE = ("site_id", "datum", "dim", "parent", "dimkey", "pv", "v")
DAILY = ("site_id", "datum", "visits", "pageviews", "uniques", "bounces", "bytes")
CELL = ("site_id", "datum", "dim", "parent", "dimkey")


def daily(sess: DataFrame, visits: DataFrame) -> DataFrame:
    """One row per site and day.  Page views and bytes count on their own day, a visit on the
    day it began; missing sides are 0."""
    hits = sess.groupBy("site_id", "datum").agg(F.count("*").alias("pageviews"), F.sum("bytes").alias("bytes"))
    people = visits.groupBy("site_id", "datum").agg(
        F.count("*").alias("visits"), F.count_distinct("vkey").alias("uniques"), F.count_if(F.col("pageviews") == 1).alias("bounces")
    )
    rows = hits.join(people, ["site_id", "datum"], "full")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in DAILY[2:]]
    return rows.select("site_id", "datum", *numbers)


def _cells(*cells: tuple[str, Column | None, Column, Column | None]) -> Column:
    """Array of the (dim, parent, dimkey) that a row belongs to; a cell whose condition fails is left out."""
    none = F.lit(None).cast("string")
    structs = []
    for dim, parent, key, condition in cells:
        cell = F.struct(F.lit(dim).alias("dim"), (none if parent is None else parent).alias("parent"), key.cast("string").alias("dimkey"))
        structs.append(cell if condition is None else F.when(condition, cell))
    return F.array_compact(F.array(*structs))


def hit_cells(sess: DataFrame) -> DataFrame:
    """Cells counted over hits: page views, and the visits they belong to."""
    c = F.col
    cells = _cells(
        ("url", None, c("url"), None),
        ("method", None, c("method"), None),
        ("hour", None, F.lpad(c("stunde").cast("string"), 2, "0"), None),
        ("download", None, c("url"), c("is_download")),
    )
    rows = sess.select("site_id", "datum", F.struct("vkey", "seq").alias("visit"), F.explode(cells).alias("cell")).select("site_id", "datum", "visit", "cell.*")
    return rows.groupBy(*CELL).agg(F.count("*").alias("pv"), F.count_distinct("visit").alias("v"))


def visit_cells(visits: DataFrame) -> DataFrame:
    """Cells counted over visits: their page views, and how many they are."""
    c = F.col
    named = c("ref_name").isNotNull()
    cells = _cells(
        ("entry", None, c("entry_url"), None),
        ("exit", None, c("exit_url"), None),
        ("referrer_type", None, c("ref_type"), None),
        ("referrer_name", c("ref_type"), c("ref_name"), named),
        ("referrer_url", c("ref_name"), c("referrer"), ~c("referrer").isin("", "-") & named),
        ("keyword", None, c("keyword"), c("keyword") != ""),
        ("country", None, c("country"), None),
        ("browser", None, c("browser"), None),
        ("browser_version", c("browser"), c("browser_version"), None),
        ("os", None, c("os"), None),
        ("os_version", c("os"), c("os_version"), None),
        ("device", None, c("device"), None),
        ("device_model", c("device"), c("device_model"), None),
    )
    rows = visits.select("site_id", "datum", "pageviews", F.explode(cells).alias("cell")).select("site_id", "datum", "pageviews", "cell.*")
    return rows.groupBy(*CELL).agg(F.sum("pageviews").alias("pv"), F.count("*").alias("v"))


def status_cells(hits_all: DataFrame) -> DataFrame:
    """Status codes over all hits, failed ones too; ``v`` counts visitors, as errors have no visit."""
    rows = hits_all.withColumns({"dim": F.lit("status"), "parent": F.lit(None).cast("string"), "dimkey": F.col("status").cast("string")})
    return rows.groupBy(*CELL).agg(F.count("*").alias("pv"), F.count_distinct("vkey").alias("v"))


def cube_rows(sess: DataFrame, visits: DataFrame, hits_all: DataFrame) -> DataFrame:
    """The whole cube.  Each relation is unpivoted and summed in one pass, so there are three
    aggregations however many dimensions there are."""
    rows = hit_cells(sess).unionByName(visit_cells(visits)).unionByName(status_cells(hits_all))
    return rows.select(*CELL, F.col("pv").cast("bigint").alias("pv"), F.col("v").cast("bigint").alias("v"))


def cube_dim(sess: DataFrame, visits: DataFrame, hits_all: DataFrame, dim: str) -> DataFrame:
    """The cells of one dimension."""
    return cube_rows(sess, visits, hits_all).where(F.col("dim") == dim)


def batch_totals(sess: DataFrame, visits: DataFrame) -> DataFrame:
    """Per site: first and last day and sums of the batch; visitors are counted once over all days."""
    hits = sess.groupBy("site_id").agg(F.min("datum").alias("von"), F.max("datum").alias("bis"), F.count("*").alias("pageviews_total"), F.sum("bytes").alias("bytes_total"))
    people = visits.groupBy("site_id").agg(
        F.count("*").alias("visits_total"), F.count_distinct("vkey").alias("uniques_total"), F.count_if(F.col("pageviews") == 1).alias("bounces_total")
    )
    return hits.join(people, "site_id")


def site_meta(daily_rows: DataFrame, sites: DataFrame, tz: str = "UTC", schema_version: int = 2, now: Column | None = None) -> DataFrame:
    """One row per site from all its days; sums add days up, so visitors count once per day.

    ``sites``: site_id, site.  Sites without days have no row.
    """
    sums = [F.sum(c).cast("bigint").alias(f"{c}_total") for c in DAILY[2:]]
    rows = daily_rows.groupBy("site_id").agg(F.min("datum").cast("string").alias("von"), F.max("datum").cast("string").alias("bis"), *sums)
    stamp = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd HH:mm")
    rows = rows.withColumns({"erzeugt": stamp, "schema_version": F.lit(schema_version), "tz": F.lit(tz)})
    return rows.join(sites.select("site_id", "site"), "site_id", "left")
