"""From parsed lines to classified hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.functions import agents, referrers, requests
from hitloom.sources.lines import LOG_TIME


def worked_out(rows: DataFrame, **values: Column) -> DataFrame:
    """Adds the columns, each worked out once for a row: a generator of one row, above which filters on them stay.
    Pushed below it, each would be worked out for the filter and again for the rows that it leaves."""
    one = F.explode(F.array(F.struct(*[v.alias(name) for name, v in values.items()])))
    rest = [c for c in rows.columns if c not in values]
    return rows.withColumn("__once", one).select(*rest, *[F.col(f"__once.{name}") for name in values])


def with_times(rows: DataFrame, ts_format: str = LOG_TIME, tz: str | Column = "UTC") -> DataFrame:
    """Adds ``ts`` (instant, null if unreadable), ``datum`` and ``stunde`` (day and hour on the
    site's own clock).  Visits run on the instant, days on the clock."""
    return with_local_times(rows.withColumn("ts", requests.parse_time(F.col("tsraw"), ts_format)), tz)


def with_local_times(rows: DataFrame, tz: str | Column = "UTC") -> DataFrame:
    return rows.withColumn("datum", requests.local_day(F.col("ts"), tz)).withColumn("stunde", requests.local_hour(F.col("ts"), tz))


def with_status_bytes(rows: DataFrame) -> DataFrame:
    """Status as a number, null if it is none; bytes, 0 if they are none."""
    size = F.coalesce(F.col("size").try_cast("bigint"), F.lit(0).cast("bigint"))
    return rows.withColumn("status", F.col("status").try_cast("int")).withColumn("bytes", size).drop("size")


def classify(rows: DataFrame, salt: str | Column, bot_pattern: str | None = None, bot_filter: bool = True, download_pattern: str | None = None) -> DataFrame:
    """Adds what the text fields tell: numbers and keys, agent and referrer."""
    return tell(rows.withColumn("is_bot", agents.is_bot(F.col("ua"), bot_pattern, bot_filter)), salt, download_pattern)


def tell(rows: DataFrame, salt: str | Column, download_pattern: str | None = None) -> DataFrame:
    """``classify`` of rows that are known to be of bots or not."""
    ip, ua, url, ref = F.col("ip"), F.col("ua"), F.col("url"), F.col("referrer")
    return rows.withColumns({
        "ipint": requests.ip_to_int(ip),
        "vkey": requests.visitor_key(ip, ua, salt),
        "is_download": requests.is_download(url, download_pattern or requests.DOWNLOADS),
        **agents.told(ua),
        "ref_host": referrers.referrer_host(ref),
        "keyword": referrers.search_keyword(ref),
    })


def clean_hits(rows: DataFrame) -> DataFrame:
    """Hits with time and status that are known to be no bot's."""
    return rows.where(F.col("ts").isNotNull() & F.col("status").isNotNull() & ~F.col("is_bot"))


def drop_assets(rows: DataFrame) -> DataFrame:
    """Without style sheets, scripts, images and fonts, and without hits that have no URL."""
    return rows.where(~requests.is_asset(F.col("url")))


def successful(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") < 400)


def before_day(rows: DataFrame, cutoff: str | Column, tz: str = "UTC") -> DataFrame:
    """Lines of days before ``cutoff`` on the site's clock: the running day waits until it is
    complete.  Lines without a readable time stay."""
    cutoff = F.lit(cutoff).cast("date") if isinstance(cutoff, str) else cutoff
    return rows.where(F.col("ts").isNull() | (requests.local_day(F.col("ts"), tz) < cutoff))


def within_days(rows: DataFrame, day_from: str | None, day_to: str | None, tz: str = "UTC") -> DataFrame:
    """Lines whose own time lies on a day of the range on the site's clock; those without a
    readable time stay, and without a range all do."""
    if not day_from:
        return rows
    day = requests.local_day(F.col("ts"), tz)
    return rows.where(F.col("ts").isNull() | day.between(F.lit(day_from).cast("date"), F.lit(day_to or day_from).cast("date")))
