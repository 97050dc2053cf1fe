"""How many different values a dimension has over any range, from bitmaps of its days.

Every value of a site's dimension gets a number in a dictionary (table ``codes``), which it keeps for good.
A day has one bitmap for each dimension, parent and stretch of 32,768 numbers, with the sums of the values
in it beside (table ``bitmaps``).  Bitmaps of days are united and their bits counted, so a range is exact
without any value being read.  Days that change are written anew; values that are gone keep their number.

One import at a time gives out numbers, as with all stored tables.  A stop between the dictionary and the
bitmaps leaves numbers that the next import uses.
"""

from __future__ import annotations

import datetime
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitloom.operators.panels import days

if TYPE_CHECKING:
    from hitloom.plans.tables import Tables

#: Stretches that the new values of one dimension are dealt into, each numbered in a task of its own.
SLOTS = 1024
VALUE = ["site_id", "dim", "dimkey"]


def numbered(values: DataFrame, known: DataFrame) -> DataFrame:
    """(site_id, dim, dimkey, code): numbers of the values that ``known``, rows like these, lacks.

    They go on gapless from the greatest known number of the site's dimension, from 1 where there is none.
    Values are dealt by hash and numbered within their slot, so a dimension of very many is no single task.
    """
    new = values.select(*VALUE).where("dimkey <> ''").distinct().join(known, VALUE, "left_anti")
    new = new.withColumn("slot", F.pmod(F.xxhash64("dimkey"), F.lit(SLOTS)))
    upto = Window.partitionBy("site_id", "dim").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = new.groupBy("site_id", "dim", "slot").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    last = known.groupBy("site_id", "dim").agg(F.max("code").alias("last"))
    starts = starts.join(last, ["site_id", "dim"], "left")
    nth = F.row_number().over(Window.partitionBy("site_id", "dim", "slot").orderBy("dimkey"))
    rows = new.withColumn("nth", nth).join(starts, ["site_id", "dim", "slot"])
    return rows.select(*VALUE, (F.coalesce("last", F.lit(0)) + F.col("start") + F.col("nth")).cast("bigint").alias("code"))


def day_bitmaps(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """(site_id, datum, dim, parent, bucket, bits, pv, v) of rows of the cube; empty keys are left out."""
    coded = rows.join(codes, VALUE).withColumn("bucket", F.bitmap_bucket_number("code"))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits")
    return coded.groupBy("site_id", "datum", "dim", "parent", "bucket").agg(bits, F.sum("pv").alias("pv"), F.sum("v").alias("v"))


def write_days(tables: Tables, rows: DataFrame, written: list[tuple[int, datetime.date]]) -> None:
    """Bitmaps of whole days of the cube, those ``written``, after their new values have got numbers."""
    sites = sorted({s for s, _ in written})
    codes = lambda: tables.read("codes").where(F.col("site_id").isin(sites))
    tables.append("codes", numbered(rows, codes()))
    tables.write("bitmaps", day_bitmaps(rows, codes()))
    tables.mark_days(tables.path("bitmaps"), written)


def _bitmaps(tables: Tables, site: int, day_from: str, day_to: str) -> DataFrame:
    inside = lambda name: {d for _, d in tables.partitions(name, site=site) if day_from <= d.isoformat() <= day_to}
    if inside("cube") - inside("bitmaps"):
        raise ValueError("some days have no bitmaps; rollups.build makes them")
    return days(tables.read("bitmaps"), site, day_from, day_to)


def _united(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, pv, v, n) of rows of ``bitmaps``; a value of several days or parents counts once."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    stretches = rows.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("pv").alias("pv"), F.sum("v").alias("v"))
    return stretches.groupBy(*keys).agg(zero("pv").alias("pv"), zero("v").alias("v"), zero(F.bitmap_count("bits")).alias("n"))


def stored_summary(tables: Tables, site: int, day_from: str, day_to: str, dim: str, parent: str | None = None) -> DataFrame:
    """What ``panels.dim_summary`` gives, from bitmaps alone."""
    rows = _bitmaps(tables, site, day_from, day_to).where(F.col("dim") == dim)
    return _united(rows if parent is None else rows.where(F.col("parent") == parent))


def stored_summaries(tables: Tables, site: int, day_from: str, day_to: str) -> DataFrame:
    """(dim, pv, v, n) of all dimensions of a site at once."""
    return _united(_bitmaps(tables, site, day_from, day_to), "dim")
