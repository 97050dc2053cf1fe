"""Report files of a web-statistics service, as history for the same cube."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.functions.rules import first_rule

# File, dimension, fields of page views and visits, and key field of each report.
REPORTS = (
    ("url.json", "url", "nb_hits", "nb_visits", "label"),
    ("download.json", "download", "nb_hits", "nb_visits", "label"),
    ("entry.json", "entry", "entry_nb_actions", "entry_nb_visits", "label"),
    ("exit.json", "exit", "nb_hits", "exit_nb_visits", "label"),
    ("country.json", "country", "nb_actions", "nb_visits", "code"),
    ("browser.json", "browser", "nb_actions", "nb_visits", "label"),
    ("os.json", "os", "nb_actions", "nb_visits", "label"),
    ("device.json", "device", "nb_actions", "nb_visits", "label"),
    ("reftype.json", "referrer_type", "nb_actions", "nb_visits", "label"),
    ("keyword.json", "keyword", "nb_actions", "nb_visits", "label"),
    ("hour.json", "hour", "nb_actions", "nb_visits", "label"),
)
REFERRER_LABELS = (("direct%", "direct"), ("search%", "search"), ("social%", "social"), ("campaign%", "website"))


def _days(spark: SparkSession, path: str) -> DataFrame:
    """(datum, body) of files that hold one JSON object by day."""
    rows = spark.read.text(path, wholetext=True)
    days = rows.select(F.explode(F.from_json("value", "map<string,string>")).alias("day", "body"))
    return days.select(F.col("day").try_cast("date").alias("datum"), "body").where("datum IS NOT NULL")


def _count(body: str, field: str) -> Column:
    return F.coalesce(F.get_json_object(body, f"$.{field}").try_cast("bigint"), F.lit(0).cast("bigint"))


def read_report_daily(spark: SparkSession, path: str) -> DataFrame:
    """(datum, visits, pageviews, uniques, bounces, bytes) of daily summaries; days that hold no
    object are skipped, counts may be texts, missing ones are 0.  Bytes are unknown and 0."""
    days = _days(spark, path).where(F.trim("body").startswith("{"))
    fields = {"visits": "nb_visits", "pageviews": "nb_actions", "uniques": "nb_uniq_visitors", "bounces": "bounce_count"}
    return days.select("datum", *[_count("body", f).alias(n) for n, f in fields.items()], F.lit(0).cast("bigint").alias("bytes"))


def read_report_dim(spark: SparkSession, path: str, dim: str, pv_field: str, v_field: str, key_field: str = "label") -> DataFrame:
    """(datum, dim, dimkey, pv, v): one row for each entry of each day's list.

    Days that hold no list and entries without key are skipped.
    """
    days = _days(spark, path).where(F.trim("body").startswith("["))
    entries = days.select("datum", F.explode(F.from_json("body", "array<string>")).alias("entry"))
    rows = entries.select("datum", F.lit(dim).alias("dim"), F.get_json_object("entry", f"$.{key_field}").alias("dimkey"), _count("entry", pv_field).alias("pv"), _count("entry", v_field).alias("v"))
    return rows.where("dimkey IS NOT NULL")


def report_key(dim: Column, key: Column) -> Column:
    """Neutral referrer kinds and upper-case countries; other keys stay."""
    kind = first_rule([(key.ilike(pattern), neutral) for pattern, neutral in REFERRER_LABELS], "website")
    return F.when(dim == "referrer_type", kind).when(dim == "country", F.upper(key)).otherwise(key)


def report_hour(key: Column) -> Column:
    """First number of the label with two digits; null without one."""
    digits = F.regexp_extract(key, r"(\d+)", 1)
    return F.when(digits != "", F.lpad(digits, 2, "0"))


def drop_zero_rows(rows: DataFrame) -> DataFrame:
    """Without the rows that have neither page views nor visits."""
    return rows.where((F.col("pv") > 0) | (F.col("v") > 0))


def report_cube(spark: SparkSession, folder: str, site_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """(cube rows, daily rows) of all report files in ``folder``, which may be a glob over the
    folders of several months: each kind of report is read once, over all of them."""
    parts = [read_report_dim(spark, f"{folder}/{name}", dim, pv, v, key) for name, dim, pv, v, key in REPORTS]
    rows = reduce(DataFrame.unionByName, parts)
    key = F.when(F.col("dim") == "hour", report_hour(F.col("dimkey"))).otherwise(report_key(F.col("dim"), F.col("dimkey")))
    rows = drop_zero_rows(rows.withColumn("dimkey", key).where("dimkey IS NOT NULL"))
    site = F.lit(site_id).cast("int").alias("site_id")
    cube = rows.select(site, "datum", "dim", F.lit(None).cast("string").alias("parent"), "dimkey", "pv", "v")
    daily = read_report_daily(spark, f"{folder}/daily.json").select(site, "datum", "visits", "pageviews", "uniques", "bounces", "bytes")
    return cube, daily
