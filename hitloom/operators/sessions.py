"""Visits: hits of a visitor without a pause of more than half an hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitloom.functions import agents
from hitloom.functions.referrers import referrer_host, referrer_name, referrer_type
from hitloom.operators.agents import apply_ua_lookup

GAP_SECONDS = 30 * 60
#: Time slices by which the hits of one visitor are dealt out.
SLICE_SECONDS = 3600


def sessionize(
    hits: DataFrame, keys: tuple[str, ...] = ("site_id", "vkey"), ts: str = "ts", gap_seconds: int = GAP_SECONDS,
    order: tuple[str, ...] = ("ts", "rid"), slice_seconds: int | None = SLICE_SECONDS,
) -> DataFrame:
    """Adds ``new_session`` (0 or 1) and ``seq``, the number of the visit of its visitor.

    A pause of exactly ``gap_seconds`` belongs to the visit; equal instants are ordered by ``rid``.

    Hits are dealt by visitor and time slice, so a visitor that has most of the hits fills no task.  Within
    a slice visits begin after pauses as ever, but for the first hit, of which the slice does not
    know.  A second pass over one narrow row for each visitor and slice carries the end of the last visit and the
    number of visits over the ends of slices.  Without ``slice_seconds`` a visitor is one group: one shuffle less.
    """
    parts = list(keys)
    if slice_seconds is not None:
        # One key that is never null, so the join below finds the hits where the windows have put them.
        parts = ["__part"]
        hits = hits.withColumn("__part", F.struct(*keys, F.floor(F.unix_seconds(ts) / slice_seconds).alias("__slice")))
    by_time = Window.partitionBy(*parts).orderBy(*order)
    pause = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(by_time))
    begins = F.when(pause <= gap_seconds * 1_000_000, 0).otherwise(1)
    running = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if slice_seconds is None:
        return hits.withColumn("new_session", begins).withColumn("seq", F.sum("new_session").over(running))
    marked = hits.withColumn("__first", F.row_number().over(by_time) == 1)
    marked = marked.withColumn("new_session", F.when(F.col("__first"), 0).otherwise(begins)).withColumn("seq", F.sum("new_session").over(running))
    spans = marked.groupBy(*parts).agg(F.min(ts).alias("__from"), F.max(ts).alias("__to"), F.sum("new_session").alias("__within"))
    spans = spans.select("*", "__part.*")
    by_slice = Window.partitionBy(*keys).orderBy("__slice")
    wait = F.unix_micros("__from") - F.unix_micros(F.lag("__to").over(by_slice))
    spans = spans.withColumn("__opens", F.when(wait <= gap_seconds * 1_000_000, 0).otherwise(1))
    before = F.sum(F.col("__opens") + F.col("__within")).over(by_slice.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("__before", F.coalesce(before, F.lit(0))).select(F.col("__part").alias("__part_of"), "__opens", "__before")
    whole = marked.join(spans, F.col("__part") == F.col("__part_of"))
    return whole.select(
        *[c for c in marked.columns if c not in ("__part", "__first", "new_session", "seq")],
        F.when(F.col("__first"), F.col("__opens")).otherwise(F.col("new_session")).alias("new_session"),
        (F.col("__before") + F.col("__opens") + F.col("seq")).alias("seq"),
    )


def visits(sess: DataFrame, keys: tuple[str, ...] = ("site_id", "vkey", "seq"), listed: DataFrame | None = None) -> DataFrame:
    """One row per visit: the day it began, page views, entry and exit page, what the agent of its first hit
    tells, and each other attribute of its first hit that has one.  Country is added by ``with_country``.
    ``listed``: what lists know of agents better (``agents.ua_lookup``)."""
    first = lambda c: F.expr(f"min_by({c}, struct(ts, rid)) FILTER (WHERE {c} IS NOT NULL)")
    firsts = ("ipint", "ip", "referrer", "keyword")
    rows = sess.groupBy(*keys).agg(
        F.min("datum").alias("datum"),
        F.count("*").alias("pageviews"),
        first("url").alias("entry_url"),
        F.expr("max_by(url, struct(ts, rid)) FILTER (WHERE url IS NOT NULL)").alias("exit_url"),
        F.min_by("ua", F.struct("ts", "rid")).alias("ua"),
        *[first(c).alias(c) for c in firsts],
    )
    rows = rows.withColumns(agents.told(F.col("ua")) | {"ref_host": referrer_host(F.col("referrer"))})
    if listed is not None:
        rows = apply_ua_lookup(rows, listed)
    return rows.withColumns({
        "browser_version": F.trim(F.concat("browser", F.lit(" "), "browser_ver")),
        "os_version": F.col("os_ver"),
        "ref_type": referrer_type(F.col("referrer"), F.col("ref_host")),
        "ref_name": referrer_name(F.col("referrer"), F.col("ref_host")),
    }).drop("ua", "browser_ver", "os_ver")
