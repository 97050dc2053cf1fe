"""Times, addresses, visitor keys, downloads and status of a request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds that count as downloads or as assets.
DOWNLOADS = r"\.(pdf|zip|7z|gz|tgz|tar|rar|docx?|xlsx?|pptx?|od[tsp]|csv|rtf|ics|epub|mp[34])([?#]|$)"
ASSETS = r"\.(css|js|png|jpg|jpeg|gif|svg|woff2?|ico|map)\z"

#: strptime codes in the words of Spark's formats.
CODES = {"d": "dd", "m": "MM", "b": "MMM", "Y": "yyyy", "y": "yy", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "z": "Z", "j": "DDD", "p": "a", "I": "hh"}


def spark_formats(ts_format: str) -> list[str]:
    """Spark patterns of a strptime format; offsets may be written ``+0200``, ``+02:00`` or ``Z``."""
    out, text, chars = "", "", iter(ts_format)

    def flush() -> str:
        return "'" + text.replace("'", "''") + "'" if any(c.isalpha() or c == "'" for c in text) else text

    for c in chars:
        if c != "%":
            text += c
            continue
        code = next(chars, "%")
        if code == "%":
            text += "%"
            continue
        if code not in CODES:
            raise ValueError(f"unknown time code %{code}")
        out, text = out + flush() + CODES[code], ""
    out += flush()
    return [out.replace("Z", z) for z in ("Z", "XXX")] if "%z" in ts_format else [out]


def parse_time(raw: Column, ts_format: str) -> Column:
    """Instant of a time text; null where it cannot be read.  Without an offset it is UTC."""
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in spark_formats(ts_format)])


def _local_seconds(ts: Column, tz: str | Column) -> Column:
    return F.unix_seconds(F.from_utc_timestamp(ts, tz))


def local_day(ts: Column, tz: str | Column) -> Column:
    """Calendar day of an instant in the zone, whatever the session's own zone."""
    return F.date_from_unix_date(F.floor(_local_seconds(ts, tz) / 86_400).cast("int"))


def local_hour(ts: Column, tz: str | Column) -> Column:
    return F.floor(F.pmod(_local_seconds(ts, tz), F.lit(86_400)) / 3_600).cast("int")


def ip_to_int(ip: Column) -> Column:
    """Dotted quad as a number (parts are not range-checked); null for all else."""
    quad = F.split(ip, r"\.")
    value = sum((F.get(quad, F.lit(i)).try_cast("bigint") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("bigint"))
    return F.when(ip.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\z"), value)


def visitor_key(ip: Column, ua: Column, salt: str | Column) -> Column:
    """Salted hash that stands for a visitor; null if any part is."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.md5(F.concat(ip, F.lit("|"), ua, F.lit("|"), salt).cast("binary"))


def is_download(url: Column, pattern: str = DOWNLOADS) -> Column:
    return F.lower(url).rlike(pattern)


def is_asset(url: Column) -> Column:
    """Style sheets, scripts, images and fonts; not if a query follows the name."""
    return url.rlike(ASSETS)


def mask_query_params(url: Column, names: list[str]) -> Column:
    """Replaces the values of the named query parameters, which stay named."""
    import re

    return F.regexp_replace(url, r"([?&])(" + "|".join(map(re.escape, names)) + r")=[^&#\s\"]*", "$1$2=REMOVED")


def truncate_ip(ip: Column) -> Column:
    """Last part of a dotted quad set to 0; other addresses stay."""
    return F.regexp_replace(ip, r"^(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d{1,3}\z", "$1.0")
