"""The parts of a dashboard, and the report that exports it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.operators import panels
from hitloom.operators.windows import resolve_window

#: Dimensions that a dashboard asks for page by page instead of whole.
PAGED = tuple(dict.fromkeys([*panels.ROOT_METRIC, *panels.CHILD_METRIC, panels.TREE_DIM]))
# Texts of the report, and its sections with dimension, title and measure.
SECTIONS = (
    ("country", "Countries", "v"),
    ("browser", "Browsers", "v"),
    ("os", "Operating systems", "v"),
    ("device", "Device types", "v"),
    ("referrer_type", "Referrer types", "v"),
    ("referrer_url", "Referrer URLs", "v"),
    ("keyword", "Search keywords", "v"),
    ("entry", "Entry pages", "v"),
    ("exit", "Exit pages", "v"),
    ("download", "Downloads", "pv"),
    ("status", "Status codes", "pv"),
    ("method", "HTTP methods", "pv"),
    ("hour", "Visiting hours (hour of day)", "pv"),
)
DAY_TITLES = ("Date", "Visits", "Page views", "Unique visitors", "Bounces", "Bytes")
MEASURES = {"v": "Visits", "pv": "Page views"}
PARTIAL = '– loaded subset only, see "+ N more" in the dashboard'
TREE_TITLE = "Pages (subtree totals) – loaded subset only, see page tree in the dashboard"
BOM = "﻿"


def dashboard(cube: DataFrame, daily: DataFrame, meta: DataFrame, site: int, days: int = 92, req_from: str | None = None, req_to: str | None = None, allowed: DataFrame | None = None) -> dict:
    """What a dashboard shows first: window, meta, days, small dimensions, two levels of the page
    tree, and the sites to choose from.  A site that may not be seen has an empty window."""
    seen = panels.visible_sites(meta, allowed)
    mine = seen.where(F.col("site_id") == site)
    ends = mine.select("von", "bis").first()
    von, bis = (str(ends.von), str(ends.bis)) if ends else (None, None)
    window = resolve_window(von, bis, days, req_from, req_to)
    held = lambda x: x if ends else x.limit(0)
    return {
        "window": window,
        "meta": mine,
        "daily": panels.daily_series(held(daily), site, *window),
        "cube": panels.cube_slice(held(cube), site, *window, exclude=PAGED),
        "tree": panels.url_tree(held(cube), site, *window),
        "sites": panels.sites(seen),
    }


def csv_safe(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula, quoted where it must be; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    text = F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(text.rlike('[";\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _line(*cells: Column | str) -> Column:
    return F.concat_ws(";", *[csv_safe(F.lit(c) if isinstance(c, str) else c) for c in cells])


def csv_report(cube: DataFrame, daily: DataFrame, meta: DataFrame, site: int, day_from: str, day_to: str) -> DataFrame:
    """(part, nth, line): head, days, a block for each dimension that has values, best first, and two
    levels of the page tree.  Of the dimensions that have a list of best values and of the tree the
    best 100 are listed, of the others all.  ``part`` and ``nth`` order the lines.

    One aggregation gives the values of all sections.
    """
    spark = cube.sparkSession

    def lines(part: Column, texts: list[Column], over: DataFrame) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(i).alias("nth"), x.alias("line")) for i, x in enumerate(texts)])
        return over.select(part.cast("int").alias("part"), F.explode(rows).alias("r")).select("part", "r.nth", "r.line")

    mine = meta.where(F.col("site_id") == site)
    head = [_line("Web statistics export"), _line("Website", F.col("site")), _line("Period", day_from, "to", day_to), _line("As of", F.col("erzeugt")), F.lit("")]
    parts = [lines(F.lit(0), head, mine), lines(F.lit(1), [_line("Trend (daily)"), _line(*DAY_TITLES)], spark.range(1))]
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("datum")) - 1  # the days of one site
    parts.append(panels.days(daily, site, day_from, day_to).select(F.lit(2).alias("part"), nth.alias("nth"), _line(F.col("datum"), *[F.col(c) for c in panels.NUMBERS]).alias("line")))

    told = [(i, d, t, m, panels.MOST_ROWS if d in panels.ROOT_METRIC else None) for i, (d, t, m) in enumerate(SECTIONS)]
    sections = spark.createDataFrame(told, "i int, dim string, title string, metric string, most int")
    cells = panels.cube_slice(cube, site, day_from, day_to).where(F.col("dim").isin([d for d, _, _ in SECTIONS]) & (F.col("dimkey") != ""))
    sums = cells.groupBy("dim", "dimkey").agg(F.sum("pv").alias("pv"), F.sum("v").alias("v")).join(F.broadcast(sections), "dim")
    measure = F.when(F.col("metric") == "v", F.col("v")).otherwise(F.col("pv"))
    best = Window.partitionBy("dim").orderBy(F.desc("measure"), "dimkey")
    ranked = sums.withColumn("measure", measure).withColumn("nth", F.row_number().over(best) - 1).where("most IS NULL OR nth < most")
    name = F.when(F.col("metric") == "v", MEASURES["v"]).otherwise(MEASURES["pv"])
    title = F.concat(F.col("title"), F.lit(" ("), name, F.lit(")"), F.when(F.col("most").isNotNull(), F.lit(f" {PARTIAL}")).otherwise(""))
    titles = F.array(*[F.struct((10 + 2 * F.col("i")).alias("part"), F.lit(n).alias("nth"), x.alias("line")) for n, x in enumerate((F.lit(""), _line(title), _line("Value", name, MEASURES["pv"], MEASURES["v"])))])
    row = F.array(F.struct((11 + 2 * F.col("i")).alias("part"), F.col("nth"), _line(F.col("dimkey"), F.col("measure"), F.col("pv"), F.col("v")).alias("line")))
    every = F.when(F.col("nth") == 0, F.concat(titles, row)).otherwise(row)
    parts.append(ranked.select(F.explode(every).alias("r")).select("r.part", "r.nth", "r.line"))

    tree = panels.url_tree(cube, site, day_from, day_to, limit=panels.MOST_ROWS)
    up = F.when(F.col("level") == 1, F.col("path")).otherwise(F.col("parent_path"))
    place = F.max(F.when(F.col("level") == 1, F.col("rnk"))).over(Window.partitionBy("up"))
    down = F.when(F.col("level") == 1, 0).otherwise(F.col("rnk"))
    order = Window.partitionBy(F.lit(0)).orderBy("place", "down")  # 100 subtrees of 100 pages at most
    rows = tree.withColumn("up", up).withColumn("place", place).withColumn("down", down).withColumn("nth", F.row_number().over(order) - 1)
    first = F.array(*[F.struct(F.lit(40).alias("part"), F.lit(n).alias("nth"), x.alias("line")) for n, x in enumerate((F.lit(""), _line(TREE_TITLE), _line("Path", MEASURES["pv"], MEASURES["v"])))])
    row = F.array(F.struct(F.lit(41).alias("part"), F.col("nth"), _line(F.col("path"), F.col("pv"), F.col("v")).alias("line")))
    parts.append(rows.select(F.explode(F.when(F.col("nth") == 0, F.concat(first, row)).otherwise(row)).alias("r")).select("r.part", "r.nth", "r.line"))
    return reduce(DataFrame.unionByName, parts)


def write_csv_report(report: DataFrame, path: str) -> None:
    """One text file with a byte order mark and CRLF line ends; a report has some 1,400 lines and
    the days of its range."""
    first = (F.col("part") == 0) & (F.col("nth") == 0)
    lines = report.coalesce(1).sortWithinPartitions("part", "nth")
    lines.select(F.concat(F.when(first, F.lit(BOM)).otherwise(F.lit("")), "line").alias("line")).write.mode("overwrite").option("lineSep", "\r\n").text(path)
