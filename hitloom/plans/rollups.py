"""Sums of the cube over blocks of days, so that long ranges and changes touch few rows.

A block of 4, 16, 64 or 256 days, counted from 1970-01-01, is a node; its sums are those of four nodes of the
level below.  A changed day changes one node of each level, which is summed from four again, and a
range of any length is a few days at its ends and a few nodes between them, its cover.  Measures of the
cube add up over days, so sums over a cover are those over the days.

Days that change are noted before they do and struck off when their nodes are right, so a stop in between is
made up for by the next refresh.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.operators.panels import page_rows
from hitloom.plans import distinct, ranking
from hitloom.plans.beside import at_once

if TYPE_CHECKING:
    from hitloom.plans.tables import Tables

#: Days of a node at each level; each is a multiple of the one before.
LEVELS = (4, 16, 64, 256)
EPOCH = datetime.date(1970, 1, 1)
CELL = ("site_id", "dim", "parent", "dimkey")
Day = tuple[int, datetime.date]


def number(day: datetime.date) -> int:
    return (day - EPOCH).days


def cover(first: int, last: int) -> list[tuple[int, int]]:
    """(level, node) of the fewest nodes that make up the days from first to last; level 1 is a day."""
    out = []
    while first <= last:
        size = next((s for s in reversed(LEVELS) if first % s == 0 and first + s - 1 <= last), 1)
        out.append((size, first // size))
        first += size
    return out


def kept(tables: Tables) -> bool:
    """Whether these tables have nodes at all: ``build`` makes the first."""
    return tables.exists(tables.path("nodes"))


def node_path(tables: Tables, table: str, site: int, level: int, node: int) -> str:
    return f"{tables.path(table)}/site_id={site}/level={level}/node={node}"


def _part(tables: Tables, site: int, level: int, node: int) -> str:
    if level == 1:
        return f"{tables.path('cube')}/site_id={site}/datum={(EPOCH + datetime.timedelta(days=node)).isoformat()}"
    return node_path(tables, "nodes", site, level, node)


def stored_cover(tables: Tables, site: int, day_from: str, day_to: str) -> list[tuple[int, int, int]]:
    """(site, level, node) of the range's cover, of what is stored of it."""
    first, last = (number(datetime.date.fromisoformat(d)) for d in (day_from, day_to))
    parts = [(site, level, node) for level, node in cover(first, last)]
    return [p for p in parts if tables.exists(_part(tables, *p))]


def node_rows(tables: Tables, parts: list[tuple[int, int, int]]) -> DataFrame:
    """(site_id, level, node, dim, parent, dimkey, pv, v) of nodes (site, level, node) that are stored."""
    days, nodes = ([_part(tables, *p) for p in parts if (p[1] == 1) == one] for one in (True, False))
    found = tables.read_parts("nodes", nodes)
    rows = tables.read_parts("cube", days).withColumns({"level": F.lit(1), "node": F.unix_date("datum")})
    return found.unionByName(rows.drop("datum"))


def note(tables: Tables, days: Iterable[Day]) -> None:
    """Days whose nodes are no longer right."""
    if kept(tables):
        tables.mark_days(f"{tables.folder}/_stale", list(days))


def _write_nodes(tables: Tables, changed: set[Day]) -> list[tuple[int, int, int]]:
    """The nodes over these days, one job a level; it reads four nodes of the level below for each node that it writes."""
    below, touched, written = 1, {(s, number(d)) for s, d in changed}, []
    for size in LEVELS:
        ratio = size // below
        blocks = sorted({(s, n // ratio) for s, n in touched})
        children = {b: [(b[0], below, b[1] * ratio + i) for i in range(ratio)] for b in blocks}
        there = {b: [c for c in x if tables.exists(_part(tables, *c))] for b, x in children.items()}
        for site, node in (b for b, x in there.items() if not x):
            tables.delete(_part(tables, site, size, node))
            tables.delete(node_path(tables, "ranked", site, size, node))
        rows = node_rows(tables, [c for x in there.values() for c in x])
        if any(there.values()):
            sums = rows.groupBy("site_id", F.floor(F.col("node") / ratio).alias("node"), *CELL[1:]).agg(F.sum("pv").alias("pv"), F.sum("v").alias("v"))
            tables.write("nodes", sums.withColumn("level", F.lit(size)))
            written += [(s, size, n) for (s, n), x in there.items() if x]
        below, touched = size, set(blocks)
    return written


def refresh(tables: Tables, days: Iterable[Day] = ()) -> list[tuple[int, int, int]]:
    """Sums the nodes over these days, and over all days noted before; gives the nodes (site, level, node) written.

    Nodes of days that are all gone go too.  The page trees and bitmaps of these days, which need no node, are written
    beside, and then the lists of days and nodes.
    """
    stale = f"{tables.folder}/_stale"
    noted = tables.partitions("cube", stale)
    changed = {*days, *noted}
    there = [p for p in ((s, 1, number(d)) for s, d in sorted(changed)) if tables.exists(_part(tables, *p))]
    for name in ("pages", "bitmaps"):
        tables.drop_days(name, sorted(changed))
    for site, day in changed:
        tables.delete(node_path(tables, "ranked", site, 1, number(day)))
    with at_once(tables.spark) as beside:
        if there:
            fresh = tables.read_parts("cube", [_part(tables, *p) for p in there])
            beside(lambda: tables.write("pages", page_rows(fresh)))
            beside(lambda: distinct.write_days(tables, fresh, [(s, EPOCH + datetime.timedelta(days=n)) for s, _, n in there]))
        written = _write_nodes(tables, changed)
        if there or written:
            ranking.write_lists(tables, [*there, *written])
    for site, day in noted:
        tables.delete(f"{stale}/site_id={site}/datum={day.isoformat()}")
    return written


def build(tables: Tables) -> None:
    """All nodes and page trees of what the cube has."""
    refresh(tables, tables.partitions("cube"))


def read_range(tables: Tables, site: int, day_from: str, day_to: str) -> DataFrame:
    """The cube's rows of a site and range as sums over its cover: every panel that sums a range gives the same
    on them.  ``datum`` is the first day of the range in all rows."""
    rows = node_rows(tables, stored_cover(tables, site, day_from, day_to))
    return rows.select("site_id", F.lit(day_from).cast("date").alias("datum"), *CELL[1:], "pv", "v")


def _covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(site, win, *part) for site, win, a, b in zip(*(c.to_pylist() for c in batch.columns)) for part in cover(a, b)]
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["site_id", "win", "level", "node"])


def rows_by_window(tables: Tables, windows: DataFrame) -> DataFrame:
    """What ``cube_by_window`` gives, but with a row for each node of a window's cover instead of each day.

    ``windows``: site_id, win, wfrom, wto; a window has some thirty nodes.
    """
    ends = windows.select(F.col("site_id").cast("int"), "win", F.unix_date("wfrom"), F.unix_date("wto"))
    parts = ends.mapInArrow(_covers, "site_id int, win string, level int, node int")
    days = tables.read("cube").withColumns({"level": F.lit(1), "node": F.unix_date("datum")}).drop("datum")
    rows = tables.read("nodes").join(parts, ["site_id", "level", "node"]).unionByName(days.join(parts.where("level = 1"), ["site_id", "level", "node"]))
    return rows.drop("level", "node")
