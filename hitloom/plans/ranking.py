"""Best values of any range from sorted lists, in three exchanges that stop early.

Every day and node (``rollups``) has a list of each ranked dimension, sorted by the dimension's own measure
(table ``ranked``), whose first hundred rows stand apart as its head.  The cover of a range has m lists:

1. The heads give partial sums; their kth is a floor that the kth best sum cannot lie below.
2. A value that stays below floor / m in all lists cannot reach the floor, so only rows from there on are
   read.  They raise the floor, and bound each value from above: what it may have in the lists that did not
   show it is less than the threshold.  Values whose bound reaches the floor remain.
3. The sums of those that remain are looked up in nodes and days, which are sorted by value.

Measures are counts, never negative.  Results are exact, ties included; where no list is steep, as many rows
are read as there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitloom.operators.panels import CHILD_METRIC, KEPT, ROOT_METRIC, check_page, default_limit, own_lists
from hitloom.plans import rollups

if TYPE_CHECKING:
    from hitloom.plans.tables import Tables

#: Values that are looked up by a filter of the scan; more are joined.
LOOKED_UP = 1_000
NODE = ("site_id", "level", "node")


def write_lists(tables: Tables, parts: list[tuple[int, int, int]]) -> None:
    """Lists of nodes and days (site, level, node); those without any value have an empty folder."""
    rows = rollups.node_rows(tables, parts)
    lists = own_lists(rows, *NODE).select(*NODE, "dim", "parent", "dimkey", "measure")
    best = Window.partitionBy(*NODE, "dim", "parent").orderBy(F.desc("measure"), "dimkey")
    # Spark keeps the best rows of each task before it shuffles, so a long list is no single task.
    heads = lists.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= KEPT).drop("nth")
    tables.write("ranked", lists.withColumn("head", F.lit(False)).unionByName(heads.withColumn("head", F.lit(True))))
    for part in parts:
        tables.mark(rollups.node_path(tables, "ranked", *part))


@dataclass(frozen=True)
class Found:
    """``rows`` (dimkey, pv, v) in order, the rows read of heads and of lists, and how many values were looked up."""

    rows: DataFrame
    heads: int
    above: int
    candidates: int


def _kth(sums: DataFrame, k: int) -> int:
    row = sums.orderBy(F.desc("s")).offset(k - 1).limit(1).first()
    return row.s if row else 0


def top_n_exchange(tables: Tables, site: int, day_from: str, day_to: str, dim: str, limit: int | None = None, offset: int = 0, parent: str | None = None) -> Found:
    """``panels.top_n_live`` by the dimension's own measure.  The tables must have nodes (``rollups.build``)."""
    own = (CHILD_METRIC if parent is not None else ROOT_METRIC).get(dim)
    if own is None:
        raise ValueError(f"{dim!r} has no lists at this level")
    limit, offset = check_page(own, default_limit(dim) if limit is None else limit, offset)
    k = offset + limit
    parts = rollups.stored_cover(tables, site, day_from, day_to)
    mine = (F.col("dim") == dim) & (F.col("parent").isNull() if parent is None else F.col("parent") == parent)
    folders = [rollups.node_path(tables, "ranked", *p) for p in parts]
    if not all(map(tables.exists, folders)):
        raise ValueError("some days have no lists; rollups.build makes them")
    lists = tables.read_parts("ranked", folders).where(mine)
    partial = lambda rows: rows.groupBy("dimkey").agg(F.sum("measure").alias("s"), F.count("*").alias("lists")).persist()
    read = lambda sums: sums.agg(F.coalesce(F.sum("lists"), F.lit(0))).first()[0]

    heads = partial(lists.where("head"))
    floor, n_heads = _kth(heads, k), read(heads)
    heads.unpersist()
    least = -(-floor // max(1, len(parts)))  # a value below it in all lists stays below the floor

    shown = partial(lists.where(~F.col("head") & (F.col("measure") >= least)))
    floor, n_above = max(floor, _kth(shown, k)), read(shown)
    most = F.col("s") + (len(parts) - F.col("lists")) * max(0, least - 1)
    left = shown.where(most >= floor).select("dimkey")
    few = [r.dimkey for r in left.limit(LOOKED_UP + 1).collect()]

    rows = rollups.node_rows(tables, parts).where(F.col("dim") == dim)
    rows = rows if parent is None else rows.where(F.col("parent") == parent)
    if len(few) <= LOOKED_UP:
        rows, n_left = rows.where(F.col("dimkey").isin(few)), len(few)
    else:
        rows, n_left = rows.join(left, "dimkey", "left_semi"), left.count()
    shown.unpersist()
    sums = rows.groupBy("dimkey").agg(F.sum("pv").alias("pv"), F.sum("v").alias("v"))
    return Found(sums.orderBy(F.desc(own), "dimkey").offset(offset).limit(limit), n_heads, n_above, n_left)
