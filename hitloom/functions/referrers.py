"""Host, kind and name of a referrer, and its search words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitloom.functions.rules import first_rule, piece

# Keys of the referrer kinds, and the hosts that belong to them.
DIRECT, SEARCH, SOCIAL, WEBSITE = "direct", "search", "social", "website"
SEARCH_HOSTS = r"(^|\.)(google|bing|duckduckgo|ecosia|startpage|qwant|yandex)\.[a-z.]+\z"
SEARCH_EXACT = ("search.brave.com",)
SOCIAL_HOSTS = r"(^|\.)(twitter|facebook|instagram|linkedin|youtube|tiktok)\.com\z"
SOCIAL_EXACT = ("t.co", "x.com")
NAMES = (
    (r"(^|\.)google\.[a-z.]+\z", (), "Google"),
    (r"(^|\.)bing\.com\z", (), "Bing"),
    (r"(^|\.)duckduckgo\.com\z", (), "DuckDuckGo"),
    (r"(^|\.)ecosia\.org\z", (), "Ecosia"),
    (r"(^|\.)startpage\.com\z", (), "Startpage"),
    (r"(^|\.)twitter\.com\z", ("t.co", "x.com"), "Twitter"),
    (r"(^|\.)facebook\.com\z", (), "Facebook"),
)


def is_direct(referrer: Column) -> Column:
    return referrer.isin("", "-")


def referrer_host(referrer: Column) -> Column:
    """Host and port of an http referrer; any other text stays as it is."""
    return F.regexp_replace(referrer, "^https?://([^/]+).*", "$1")


def search_keyword(referrer: Column) -> Column:
    """Value of ``q``, plus signs as spaces and nothing decoded; null without ``q``."""
    return F.when(referrer.rlike("[?&]q="), F.translate(piece(referrer, "[?&]q=([^&]+)"), "+", " "))


def referrer_type(referrer: Column, host: Column) -> Column:
    return first_rule(
        [
            (is_direct(referrer), DIRECT),
            (host.rlike(SEARCH_HOSTS) | host.isin(*SEARCH_EXACT), SEARCH),
            (host.isin(*SOCIAL_EXACT) | host.rlike(SOCIAL_HOSTS), SOCIAL),
        ],
        WEBSITE,
    )


def referrer_name(referrer: Column, host: Column) -> Column:
    """Brand of the host or the host itself; null for direct visits."""
    known = [(host.rlike(pattern) | host.isin(*exact) if exact else host.rlike(pattern), name) for pattern, exact, name in NAMES]
    return first_rule([(is_direct(referrer), F.lit(None).cast("string")), *known], host)
