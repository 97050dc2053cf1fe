"""Ranges of days: dashboard windows, presets, comparison periods, months."""

from __future__ import annotations

import datetime
import re
from calendar import monthrange

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = datetime.timedelta(days=1)
EMPTY = ("1970-01-01", "1970-01-01")
#: Presets whose best rows are kept ready.
PRECOMPUTED = ("last30", "last90", "last365", "thisyear", "lastyear", "all")


def iso_day(text: str | None) -> datetime.date | None:
    """A calendar day written YYYY-MM-DD; null for any other text."""
    if text is None or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return None
    try:
        return datetime.date.fromisoformat(text)
    except ValueError:
        return None


def _within(day: datetime.date, low: datetime.date, high: datetime.date) -> datetime.date:
    return max(low, min(day, high))


def resolve_window(von: str | None, bis: str | None, days: int = 92, req_from: str | None = None, req_to: str | None = None) -> tuple[str, str]:
    """The days to show: what was asked for, held within the data, else the last ``days`` of it
    (0: all).  Texts that are no days count as not asked.  Without data an empty window."""
    low, high = iso_day(von), iso_day(bis)
    if low is None or high is None:
        return EMPTY
    end = _within(iso_day(req_to) or high, low, high)
    if (asked := iso_day(req_from)) is not None:
        start = _within(asked, low, end)
    else:
        start = _within(end - (days - 1) * DAY, low, end) if days > 0 else low
    return min(start, end).isoformat(), end.isoformat()


def _preset(name: str, von: datetime.date, bis: datetime.date, anchor: datetime.date) -> tuple[datetime.date, datetime.date] | None:
    year = lambda y: (datetime.date(y, 1, 1), datetime.date(y, 12, 31))
    month = lambda d: (d.replace(day=1), d.replace(day=monthrange(d.year, d.month)[1]))
    if match := re.fullmatch(r"last(\d+)", name):
        return anchor - (int(match[1]) - 1) * DAY, anchor
    if match := re.fullmatch(r"year:(\d{4})", name):
        return year(int(match[1]))
    return {
        "today": lambda: (anchor, anchor),
        "yesterday": lambda: (anchor - DAY, anchor - DAY),
        "thismonth": lambda: month(anchor),
        "lastmonth": lambda: month(anchor.replace(day=1) - DAY),
        "thisyear": lambda: year(anchor.year),
        "lastyear": lambda: year(anchor.year - 1),
        "all": lambda: (von, bis),
    }.get(name, lambda: None)()


def preset_range(name: str, von: str, bis: str, today: str) -> tuple[str, str] | None:
    """Days of a dashboard preset, anchored at today or the last day with data, whichever is
    earlier, and held within the data.  Null for unknown names, ``custom`` among them."""
    low, high = datetime.date.fromisoformat(von), datetime.date.fromisoformat(bis)
    found = _preset(name, low, high, min(datetime.date.fromisoformat(today), high))
    return found and (max(found[0], low).isoformat(), min(found[1], high).isoformat())


def window_bounds(name: str, von: str | None, bis: str | None) -> tuple[str, str] | None:
    """Bounds of a precomputed preset, anchored at the last day; null if unknown or empty."""
    low, high = iso_day(von), iso_day(bis)
    if name not in PRECOMPUTED or low is None or high is None:
        return None
    start, end = _preset(name, low, high, high)
    start, end = max(start, low), min(end, high)
    return (start.isoformat(), end.isoformat()) if start <= end else None


def preset_windows(meta: DataFrame) -> DataFrame:
    """(site_id, win, wfrom, wto): the precomputed presets of every site, within its data."""
    bis, von = F.col("bis").cast("date"), F.col("von").cast("date")
    year = F.trunc(bis, "year")
    bounds = {
        "last30": (F.date_sub(bis, 29), bis),
        "last90": (F.date_sub(bis, 89), bis),
        "last365": (F.date_sub(bis, 364), bis),
        "thisyear": (year, F.date_sub(F.add_months(year, 12), 1)),
        "lastyear": (F.add_months(year, -12), F.date_sub(year, 1)),
        "all": (von, bis),
    }
    rows = [F.struct(F.lit(w).alias("win"), F.greatest(a, von).alias("wfrom"), F.least(b, bis).alias("wto")) for w, (a, b) in bounds.items()]
    return meta.select("site_id", F.explode(F.array(*rows)).alias("w")).select("site_id", "w.*").where("wfrom <= wto")


def cube_by_window(cube: DataFrame, windows: DataFrame) -> DataFrame:
    """The cube's rows with each preset of their site that they lie in.

    A row goes to its windows through its site, of which it has six at most.
    """
    return cube.join(windows, "site_id").where(F.col("datum").between(F.col("wfrom"), F.col("wto"))).drop("wfrom", "wto")


def previous_period(day_from: str, day_to: str, von: str) -> tuple[str, str] | None:
    """As many days just before; null if these would begin before the data does."""
    start, end = datetime.date.fromisoformat(day_from), datetime.date.fromisoformat(day_to)
    before = start - DAY - (end - start)
    return None if before < datetime.date.fromisoformat(von) else (before.isoformat(), (start - DAY).isoformat())


def month_chunks(spark: SparkSession, day_from: str, day_to: str) -> DataFrame:
    """(chunk_from, chunk_to): the months of the range, the first and last one cut to it."""
    ends = spark.sql("SELECT CAST(:a AS DATE) AS a, CAST(:b AS DATE) AS b", args={"a": day_from, "b": day_to})
    months = ends.where("a <= b").select("a", "b", F.explode(F.sequence(F.trunc("a", "month"), F.col("b"), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    return months.select(F.greatest("m", "a").alias("chunk_from"), F.least(F.last_day("m"), F.col("b")).alias("chunk_to"))
