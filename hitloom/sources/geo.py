"""Country ranges of IP addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.functions.network import ip6_hex
from hitloom.functions.requests import ip_to_int

SOURCES = ("native", "ip2location", "dbip", "maxmind")


def read_geo(spark: SparkSession, source: str, path: str, locations: str | None = None) -> DataFrame:
    """(start, end, cc): IPv4 ranges as numbers, both ends included.

    ``maxmind`` takes networks and, in ``locations``, the countries of their places; networks
    without a place of their own use that of their registration.
    """
    if source == "native":
        return spark.read.csv(path, schema="start bigint, end bigint, cc string")
    if source == "ip2location":
        return spark.read.csv(path, schema="start bigint, end bigint, cc string, name string").drop("name")
    if source == "dbip":
        rows = spark.read.csv(path, schema="first string, last string, cc string").where(~F.col("first").contains(":"))
        return rows.select(ip_to_int(F.col("first")).alias("start"), ip_to_int(F.col("last")).alias("end"), "cc")
    if source != "maxmind":
        raise ValueError(f"unknown geo source {source!r}; known: {', '.join(SOURCES)}")
    if not locations:
        raise ValueError("maxmind needs the file of locations")
    places = spark.read.csv(locations, header=True).select(F.col("geoname_id").try_cast("bigint").alias("place"), F.col("country_iso_code").alias("cc"))
    blocks = spark.read.csv(path, header=True).where(~F.col("network").contains(":"))
    place = F.coalesce(F.col("geoname_id").try_cast("bigint"), F.col("registered_country_geoname_id").try_cast("bigint"))
    base = ip_to_int(F.substring_index("network", "/", 1))
    bits = F.substring_index("network", "/", -1).try_cast("int")
    rows = blocks.select(base.alias("start"), bits.alias("bits"), place.alias("place")).join(places, "place")
    return rows.select("start", (F.col("start") + F.expr("shiftleft(1L, 32 - bits)") - 1).alias("end"), "cc")


def read_geo6(spark: SparkSession, path: str) -> DataFrame:
    """(start_hex, end_hex, cc): IPv6 ranges as 32 hex digits; other rows are skipped."""
    rows = spark.read.csv(path, schema="first string, last string, cc string").where(F.col("first").contains(":"))
    rows = rows.select(ip6_hex(F.col("first")).alias("start_hex"), ip6_hex(F.col("last")).alias("end_hex"), "cc")
    return rows.where("start_hex IS NOT NULL")
