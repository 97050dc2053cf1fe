"""Browser, system and device of a user agent, and whether it is a bot."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitloom.functions.rules import first_rule, has_all, piece

# The labels and markers by which stored cubes know browsers, systems and devices.
BROWSERS = (
    (("Firefox",), "Firefox"),
    (("Edg",), "Edge"),
    (("OPR/",), "Opera"),
    (("Opera",), "Opera"),
    (("Chrome", "Mobile"), "Chrome Mobile"),
    (("Chrome",), "Chrome"),
    (("iPhone",), "Mobile Safari"),
    (("Safari",), "Safari"),
)
BROWSER_VERSIONS = (
    ("Firefox", r"Firefox/([0-9.]+)"),
    ("Edg", r"Edg[A-Za-z]*/([0-9.]+)"),
    ("OPR/", r"OPR/([0-9.]+)"),
    ("Chrome", r"Chrome/([0-9.]+)"),
    ("Version/", r"Version/([0-9.]+)"),
)
SYSTEMS = (
    ("Windows", "Windows"),
    ("Android", "Android"),
    ("iPhone", "iOS"),
    ("Macintosh", "macOS"),
    ("Linux", "Linux"),
)
OTHER = "Andere"
WINDOWS_10, WINDOWS_OLD = "Windows 10/11", "Windows (älter)"
PHONE, DESKTOP = "Smartphone", "Desktop"
IPHONE, OTHER_PHONE, DESKTOP_PC = "Apple iPhone", "Smartphone (sonstige)", "Desktop-PC"
WINDOWS_RELEASES = (
    ("10.0", "10/11"),
    ("6.3", "8.1"),
    ("6.2", "8"),
    ("6.1", "7"),
    ("6.0", "Vista"),
    ("5.1", "XP"),
    ("5.2", "XP"),
)
BOTS = (
    "bot", "crawl", "spider", "slurp", "curl", "wget", "python-requests", "python/", "go-http-client", "okhttp", "java/", "libwww",
    "httpclient", "headless", "phantomjs", "lighthouse", "pingdom", "uptimerobot", "statuscake", "monitor", "nagios", "zabbix",
    "masscan", "nmap", "zgrab", "facebookexternalhit", "feedfetcher", "archive.org",
)


def browser(ua: Column) -> Column:
    return first_rule([(has_all(ua, parts), label) for parts, label in BROWSERS], OTHER)


def browser_version(ua: Column) -> Column:
    """'' for browsers without a known version mark."""
    return first_rule([(ua.contains(mark), piece(ua, pattern)) for mark, pattern in BROWSER_VERSIONS], "")


def os_family(ua: Column) -> Column:
    return first_rule([(ua.contains(mark), label) for mark, label in SYSTEMS], OTHER)


def os_version(ua: Column) -> Column:
    def dotted(pattern: str) -> Column:
        return F.translate(piece(ua, pattern), "_", ".")

    return first_rule(
        [
            (ua.contains("Windows NT 10.0"), WINDOWS_10),
            (ua.contains("Windows"), WINDOWS_OLD),
            (ua.contains("Android"), F.concat(F.lit("Android "), piece(ua, r"Android ([0-9.]+)"))),
            (ua.contains("iPhone OS"), F.concat(F.lit("iOS "), dotted(r"iPhone OS ([0-9_]+)"))),
            (ua.contains("Mac OS X"), F.concat(F.lit("macOS "), dotted(r"Mac OS X ([0-9_]+)"))),
            (ua.contains("Linux"), "Linux"),
        ],
        OTHER,
    )


def device(ua: Column) -> Column:
    return F.when(ua.contains("iPhone") | ua.contains("Mobile"), F.lit(PHONE)).otherwise(F.lit(DESKTOP))


def device_model(ua: Column) -> Column:
    return first_rule(
        [
            (ua.contains("iPhone"), IPHONE),
            (ua.contains("Pixel"), F.concat(F.lit("Google "), piece(ua, r"(Pixel [0-9]+)"))),
            (ua.contains("Mobile"), OTHER_PHONE),
        ],
        DESKTOP_PC,
    )


def told(ua: Column) -> dict[str, Column]:
    """All that an agent tells; no value is ever null."""
    return {
        "browser": browser(ua),
        "browser_ver": browser_version(ua),
        "os": os_family(ua),
        "os_ver": os_version(ua),
        "device": device(ua),
        "device_model": device_model(ua),
    }


def windows_version(version: Column) -> Column:
    """Marketing name of a Windows NT number; other versions stay."""
    return first_rule([(version.startswith(number), name) for number, name in WINDOWS_RELEASES], version)


def is_bot(ua: Column, pattern: str | None = None, enabled: bool = True, low: Column | None = None) -> Column:
    """Whether the agent matches the pattern, or without one has a mark of ``BOTS`` in any case.

    Null for a null user agent, unless the filter is off.  ``low``: the agent in lower case, where it is at hand.
    """
    if pattern is not None:
        return F.lit(enabled) & ua.rlike(pattern)
    low = F.lower(ua) if low is None else low
    return F.lit(enabled) & reduce(or_, [low.contains(mark) for mark in BOTS])
