"""Freshness, schema and smoke checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.plans.tables import SCHEMA_VERSION, Tables

LEVELS = ("OK", "WARN", "CRIT", "UNKNOWN")


def freshness(meta: DataFrame, now: Column, warn_h: int = 26, crit_h: int = 50) -> DataFrame:
    """(site_id, site, status, last_data, age_hours): whole hours since the last second of the
    last day with data, on the site's clock.  A site without data is CRIT."""
    if crit_h < warn_h:
        raise ValueError("crit_h must not be below warn_h")
    tz = F.coalesce(F.nullif(F.col("tz"), F.lit("")), F.lit("UTC"))
    last = F.nullif(F.col("bis").cast("string"), F.lit(""))
    # Days since 1970 keep the wall-clock end of the day independent of the session's own zone.
    wall = F.timestamp_seconds((F.unix_date(last.try_cast("date")) + 1).cast("bigint") * 86_400 - 1)
    age = F.floor((F.unix_seconds(now) - F.unix_seconds(F.to_utc_timestamp(wall, tz))) / 3_600).cast("bigint")
    rows = meta.withColumns({"last_data": last, "age_hours": age})
    status = (
        F.when(F.col("last_data").isNull(), "CRIT")
        .when(F.col("age_hours").isNull(), "UNKNOWN")
        .when(F.col("age_hours") >= crit_h, "CRIT")
        .when(F.col("age_hours") >= warn_h, "WARN")
        .otherwise("OK")
    )
    return rows.select("site_id", F.coalesce("site", F.col("site_id").cast("string")).alias("site"), status.alias("status"), "last_data", "age_hours")


def freshness_summary(rows: DataFrame) -> DataFrame:
    """(status, ok, sites): the worst status, and how many sites are fresh; CRIT without sites."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("status"))
    worst = rows.agg(F.max(rank).cast("int").alias("worst"), F.count_if(F.col("status") == "OK").alias("ok"), F.count("*").alias("sites"))
    return worst.select(F.coalesce(F.get(F.array(*[F.lit(x) for x in LEVELS]), F.col("worst") - 1), F.lit("CRIT")).alias("status"), "ok", "sites")


def schema_version(meta: DataFrame) -> int | None:
    """Highest version of the tables, null for tables that have none."""
    return meta.agg(F.max("schema_version")).first()[0] if "schema_version" in meta.columns else None


def assert_schema(meta: DataFrame) -> None:
    """Raises unless the tables have just the version that this library reads."""
    if (found := schema_version(meta)) != SCHEMA_VERSION:
        raise ValueError(f"tables have schema version {found}; this library reads {SCHEMA_VERSION}")


def table_counts(tables: Tables) -> DataFrame:
    """(site_id, cube, daily, topn): stored rows of each site."""
    counted = [tables.read(n).select("site_id", F.lit(n).alias("name")) for n in ("cube", "daily", "topn")]
    rows = counted[0].unionByName(counted[1]).unionByName(counted[2])
    return rows.groupBy("site_id").pivot("name", ["cube", "daily", "topn"]).count().na.fill(0)


def smoke(tables: Tables) -> DataFrame:
    """(check, n, ok): sites, visits, days and cube rows, each of which must be there."""
    visits = tables.read("meta").agg(F.coalesce(F.sum("visits_total"), F.lit(0)).cast("bigint").alias("n"))
    parts = [tables.read(t).agg(F.count("*").alias("n")).withColumn("check", F.lit(c)) for c, t in (("sites", "meta"), ("daily", "daily"), ("cube", "cube"))]
    rows = visits.withColumn("check", F.lit("visits_total"))
    for part in parts:
        rows = rows.unionByName(part)
    return rows.select("check", "n", (F.col("n") > 0).alias("ok"))
