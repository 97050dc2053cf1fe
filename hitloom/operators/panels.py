"""Questions asked of the cube: sums, best values, trees, comparisons and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.operators.geo import UNKNOWN
from hitloom.operators.windows import PRECOMPUTED, cube_by_window, preset_windows, previous_period, window_bounds

# The measure that ranks each dimension, at top level and below a parent.
ROOT_METRIC = {
    "keyword": "v",
    "entry": "v",
    "exit": "v",
    "download": "pv",
    "status": "pv",
    "method": "pv",
    "browser": "v",
    "os": "v",
    "device": "v",
    "referrer_type": "v",
    "referrer_url": "v",
}
CHILD_METRIC = {
    "browser_version": "v",
    "os_version": "v",
    "device_model": "v",
    "referrer_name": "v",
    "referrer_url": "v",
}
TREE_DIM = "url"
DEFAULT_LIMIT, LIMITS = 8, {"referrer_url": 10}
MOST_ROWS, MOST_SKIPPED = 100, 10_000
KEPT = 100
METRICS = ("pv", "v")


def default_limit(dim: str) -> int:
    return LIMITS.get(dim, DEFAULT_LIMIT)


def days(rows: DataFrame, site: int, day_from: str, day_to: str) -> DataFrame:
    """Rows of a site within the days; both prune the partitions of stored tables."""
    return rows.where((F.col("site_id") == site) & F.col("datum").between(F.lit(day_from).cast("date"), F.lit(day_to).cast("date")))


def cube_slice(cube: DataFrame, site: int, day_from: str, day_to: str, dim: str | None = None, parent: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a site, range, dimension and parent (exactly that value), without dimensions."""
    rows = days(cube, site, day_from, day_to)
    if dim is not None:
        rows = rows.where(F.col("dim") == dim)
    if parent is not None:
        rows = rows.where(F.col("parent") == parent)
    return rows.where(~F.col("dim").isin(*exclude)) if exclude else rows


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("dimkey") != "")


def dim_summary(cube: DataFrame, site: int, day_from: str, day_to: str, dim: str, parent: str | None = None) -> DataFrame:
    """One row: sums of page views and visits, and the number of values; empty keys left out."""
    rows = _keyed(cube_slice(cube, site, day_from, day_to, dim, parent))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return rows.agg(zero("pv"), zero("v"), F.count_distinct("dimkey").alias("n"))


def dim_totals(cube: DataFrame, site: int, day_from: str, day_to: str, dim: str) -> DataFrame:
    """(dimkey, pv, v) of a dimension over the range, empty keys left out."""
    rows = _keyed(cube_slice(cube, site, day_from, day_to, dim))
    return rows.groupBy("dimkey").agg(F.sum("pv").alias("pv"), F.sum("v").alias("v"))


def check_page(metric: str, limit: int, offset: int) -> tuple[int, int]:
    """Limit and offset within what may be asked for; an unknown measure is an error."""
    if metric not in METRICS:
        raise ValueError(f"unknown measure {metric!r}")
    return max(1, min(MOST_ROWS, limit)), max(0, min(MOST_SKIPPED, offset))


def top_n_live(cube: DataFrame, site: int, day_from: str, day_to: str, dim: str, metric: str = "v", limit: int = DEFAULT_LIMIT, offset: int = 0, parent: str | None = None) -> DataFrame:
    """(dimkey, pv, v): the best values of a dimension, ties by key.  Spark keeps only the best
    ``offset + limit`` rows of each partition."""
    limit, offset = check_page(metric, limit, offset)
    rows = _keyed(cube_slice(cube, site, day_from, day_to, dim, parent))
    sums = rows.groupBy("dimkey").agg(F.sum("pv").alias("pv"), F.sum("v").alias("v"))
    return sums.orderBy(F.desc(metric), "dimkey").offset(offset).limit(limit)


def topn_table(cube: DataFrame, meta: DataFrame, k: int = KEPT) -> DataFrame:
    """(site_id, win, dim, parent, dimkey, pv, v, rnk): the ``k`` best values of each precomputed
    preset, of top-level dimensions as one list and of the lower ones for each parent."""
    return best_by_window(cube_by_window(cube, preset_windows(meta)), k)


def own_lists(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, dim, parent, dimkey, pv, v, measure): for each of ``keys`` the values of every ranked dimension, at top
    level (parent is null, all parents summed) and for each parent, with the dimension's own measure beside both.

    ``rows``: (keys, dim, parent, dimkey, pv, v), of which rows of one cell add up.
    """
    rows = _keyed(rows)
    none = F.lit(None).cast("string")
    sums = lambda x: x.groupBy(*keys, "dim", "parent", "dimkey").agg(F.sum("pv").alias("pv"), F.sum("v").alias("v"))
    root = sums(rows.where(F.col("dim").isin(*ROOT_METRIC)).withColumn("parent", none))
    child = sums(rows.where(F.col("dim").isin(*CHILD_METRIC) & F.col("parent").isNotNull()))
    by_pv = [d for d, m in ROOT_METRIC.items() if m == "pv"]
    measure = F.when(F.col("parent").isNull() & F.col("dim").isin(*by_pv), F.col("pv")).otherwise(F.col("v"))
    return root.unionByName(child).withColumn("measure", measure)


def best_by_window(rows: DataFrame, k: int = KEPT) -> DataFrame:
    """``topn_table`` from (site_id, win, dim, parent, dimkey, pv, v), of which rows of one cell add up."""
    best = Window.partitionBy("site_id", "win", "dim", "parent").orderBy(F.desc("measure"), "dimkey")
    ranked = own_lists(rows, "site_id", "win").withColumn("rnk", F.row_number().over(best))
    return ranked.where(F.col("rnk") <= k).select("site_id", "win", "dim", "parent", "dimkey", "pv", "v", F.col("rnk").cast("smallint").alias("rnk"))


def top_n(cube: DataFrame, site: int, day_from: str, day_to: str, dim: str, metric: str | None = None, limit: int | None = None, offset: int = 0, parent: str | None = None, window: str | None = None, topn: DataFrame | None = None, meta: DataFrame | None = None) -> DataFrame:
    """``top_n_live``, or the same rows from the precomputed table where that is sure to agree.

    It is if ``window`` names a preset whose bounds for this site are just the days asked for,
    the measure is the dimension's own, the page lies within the kept rows, and the table has a
    first row for it.  One job tells all that, and brings the page along.
    """
    own = (CHILD_METRIC if parent is not None else ROOT_METRIC).get(dim)
    metric = metric or own or "v"
    limit, offset = check_page(metric, default_limit(dim) if limit is None else limit, offset)
    if window in PRECOMPUTED and topn is not None and meta is not None and metric == own and offset + limit <= KEPT:
        same_parent = F.col("parent").isNull() if parent is None else F.col("parent") == parent
        rows = topn.where((F.col("site_id") == site) & (F.col("win") == window) & (F.col("dim") == dim) & same_parent & (F.col("rnk") <= offset + limit))
        ends = meta.where(F.col("site_id") == site).select("site_id", "von", "bis")
        kept = rows.select("site_id", "rnk", "dimkey", "pv", "v").join(ends, "site_id").collect()  # a hundred rows at most, of one site
        if any(r.rnk == 1 and window_bounds(window, str(r.von), str(r.bis)) == (day_from, day_to) for r in kept):
            page = sorted((r.rnk, r.dimkey, r.pv, r.v) for r in kept if r.rnk > offset)
            return cube.sparkSession.createDataFrame([x[1:] for x in page], "dimkey string, pv bigint, v bigint")
    return top_n_live(cube, site, day_from, day_to, dim, metric, limit, offset, parent)


def with_share(rows: DataFrame, summary: DataFrame, metric: str = "v") -> DataFrame:
    """Adds ``share`` of the dimension's sum and ``bar`` of the largest shown value, in percent,
    and ``more``, the number of values not shown.  ``rows`` is a page, ``summary`` one row."""
    total = summary.first()
    shown = Window.partitionBy(F.lit(0))  # a page of 100 rows at most
    part = lambda value, whole: F.when(whole > 0, 100.0 * value / whole)
    return rows.withColumns({
        "share": part(F.col(metric), F.lit(total[metric])),
        "bar": part(F.col(metric), F.max(metric).over(shown)),
        "more": F.lit(total["n"]) - F.count("*").over(shown),
    })


def sites(meta: DataFrame) -> DataFrame:
    return meta.select("site_id", "site").orderBy("site", "site_id")


def visible_sites(meta: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Sites that may be seen: all without a list (None), else those on it; none on an empty one."""
    return meta if allowed is None else meta.join(allowed.select("site_id").distinct(), "site_id", "left_semi")


def daily_series(daily: DataFrame, site: int, day_from: str, day_to: str) -> DataFrame:
    return days(daily, site, day_from, day_to).drop("site_id").orderBy("datum")


NUMBERS = ("visits", "pageviews", "uniques", "bounces", "bytes")


def bounce_rate(bounces: Column, visits: Column) -> Column:
    """Percent of visits with one page; null without visits."""
    return F.when(visits > 0, 100.0 * bounces / visits)


def kpis(daily: DataFrame, site: int, day_from: str, day_to: str) -> DataFrame:
    """One row: sums of the range and the bounce rate."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in NUMBERS]
    return days(daily, site, day_from, day_to).agg(*sums).withColumn("bounce_rate", bounce_rate(F.col("bounces"), F.col("visits")))


def kpi_deltas(daily: DataFrame, site: int, day_from: str, day_to: str, von: str) -> DataFrame:
    """(kpi, cur, prev, delta, trend, good): each key figure against the period before.

    ``delta`` is in percent; ``trend`` is up, down or flat (within 0.05), ``new`` where the earlier
    value is 0 and the later is not, and null where no full period came before.  More is good,
    but for the bounce rate.
    """
    names = (*NUMBERS, "bounce_rate")
    before = previous_period(day_from, day_to, von)
    inside = F.col("datum").between(F.lit(day_from).cast("date"), F.lit(day_to).cast("date"))
    rows = days(daily, site, before[0] if before else day_from, day_to).withColumn("now", inside)
    part = lambda c, now: F.coalesce(F.sum(F.when(F.col("now") == now, F.col(c))), F.lit(0)).cast("double")
    sums = rows.agg(*[part(c, n).alias(f"{c}_{i}") for c in NUMBERS for i, n in (("cur", True), ("prev", False))])
    sums = sums.withColumns({f"bounce_rate_{i}": bounce_rate(F.col(f"bounces_{i}"), F.col(f"visits_{i}")) for i in ("cur", "prev")})
    old = (lambda c: F.col(f"{c}_prev")) if before else (lambda c: F.lit(None).cast("double"))
    lines = F.array(*[F.struct(F.lit(c).alias("kpi"), F.col(f"{c}_cur").alias("cur"), old(c).alias("prev")) for c in names])
    rows = sums.select(F.explode(lines).alias("x")).select("x.*")
    delta = F.when(F.col("prev") != 0, 100.0 * (F.col("cur") - F.col("prev")) / F.col("prev"))
    trend = (
        F.when(F.col("prev").isNull(), None)
        .when(F.col("prev") == 0, F.when(F.col("cur") > 0, "new").otherwise("flat"))
        .when(delta > 0.05, "up")
        .when(delta < -0.05, "down")
        .when(delta.isNotNull(), "flat")
    )
    rows = rows.withColumns({"delta": delta, "trend": trend})
    wanted = F.when(F.col("kpi") == "bounce_rate", "down").otherwise("up")
    return rows.withColumn("good", F.when(F.col("trend").isin("up", "down"), F.col("trend") == wanted))


def trend(daily: DataFrame, site: int, day_from: str, day_to: str, von: str | None = None, compare: bool = False) -> DataFrame:
    """(datum, pageviews, visits, uniques, pageviews_prev): the days of the range in order; with
    ``compare`` the nth day of the period before stands beside the nth day."""
    shown = daily_series(daily, site, day_from, day_to).select("datum", "pageviews", "visits", "uniques")
    before = previous_period(day_from, day_to, von) if compare and von else None
    if before is None:
        return shown.withColumn("pageviews_prev", F.lit(None).cast("bigint"))
    nth = lambda x: x.withColumn("nth", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("datum")))  # noqa: E731 - days of one site
    earlier = nth(days(daily, site, *before).select("datum", F.col("pageviews").alias("pageviews_prev"))).drop("datum")
    return nth(shown).join(earlier, "nth", "left").drop("nth").orderBy("datum")


def hour_profile(cube: DataFrame, site: int, day_from: str, day_to: str) -> DataFrame:
    """(hour, pv, v) of all 24 hours, 0 where nothing came."""
    hours = cube.sparkSession.range(24).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("hour"))
    found = dim_totals(cube, site, day_from, day_to, "hour").withColumnRenamed("dimkey", "hour")
    rows = hours.join(found, "hour", "left")
    return rows.select("hour", F.coalesce("pv", F.lit(0)).cast("bigint").alias("pv"), F.coalesce("v", F.lit(0)).cast("bigint").alias("v")).orderBy("hour")


def country_intensity(cube: DataFrame, site: int, day_from: str, day_to: str) -> DataFrame:
    """(dimkey, v, intensity): root of the share of the largest country; unknown ones left out."""
    rows = dim_totals(cube, site, day_from, day_to, "country").where(F.col("dimkey") != UNKNOWN)
    most = F.max("v").over(Window.partitionBy(F.lit(0)))  # a few hundred countries
    return rows.select("dimkey", "v", F.sqrt(F.col("v") / F.greatest(most, F.lit(1))).alias("intensity"))


def _segments(cube: DataFrame, site: int, day_from: str, day_to: str, path: str, depth: int) -> DataFrame:
    """Rows below ``path`` with their next path segments s0, s1, ... and what follows the slash
    after each: r0, r1, ..., '' where nothing does."""
    rows = cube_slice(cube, site, day_from, day_to, TREE_DIM).where(F.startswith("dimkey", F.lit(path + "/")))
    left = F.substring(F.col("dimkey"), len(path) + 2, 1 << 30)
    for i in range(depth):
        rows = rows.withColumn(f"s{i}", F.substring_index(left, "/", 1))
        rows = rows.withColumn(f"r{i}", F.substring(left, F.length(f"s{i}") + 2, F.lit(1 << 30)))
        left = F.col(f"r{i}")
    return rows.where("s0 <> ''")


def url_tree_children(cube: DataFrame, site: int, day_from: str, day_to: str, path: str = "", metric: str = "pv", limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """(segment, path, pv, v, has_children, n): the subtrees below ``path``, best first.

    A subtree counts its own page; it has children if something follows its next slash; ``n`` is
    the number of subtrees in all.
    """
    limit, offset = check_page(metric, limit, offset)
    rows = _segments(cube, site, day_from, day_to, path, 1)
    sums = rows.groupBy(F.col("s0").alias("segment")).agg(F.sum("pv").alias("pv"), F.sum("v").alias("v"), F.max(F.col("r0") != "").alias("has_children"))
    n = rows.select("s0").distinct().count()
    page = sums.orderBy(F.desc(metric), "segment").offset(offset).limit(limit)
    return page.select("segment", F.concat(F.lit(path + "/"), "segment").alias("path"), "pv", "v", "has_children", F.lit(n).cast("bigint").alias("n"))


def url_tree(cube: DataFrame, site: int, day_from: str, day_to: str, path: str = "", metric: str = "pv", limit: int = DEFAULT_LIMIT, offset: int = 0, depth: int = 2) -> DataFrame:
    """(level, path, parent_path, pv, v, has_children, rnk, n): one or two levels below ``path`` at once.

    One aggregation by both segments gives both levels; of the first level ``limit`` subtrees from
    ``offset`` on are kept, and of each of these its best ``limit``.  ``n`` is the number of subtrees
    that the parent has in all, so that what is not shown can be told.
    """
    limit, offset = check_page(metric, limit, offset)
    rows = _segments(cube, site, day_from, day_to, path, 2)
    cells = rows.groupBy("s0", "s1").agg(
        F.sum("pv").alias("pv"), F.sum("v").alias("v"), F.max(F.col("r0") != "").alias("more"), F.max(F.col("r1") != "").alias("deep")
    )
    first = cells.groupBy("s0").agg(
        F.sum("pv").alias("pv"), F.sum("v").alias("v"), F.max("more").alias("has_children"), F.count_if(F.col("s1") != "").alias("below")
    )
    n = first.agg(F.count("*").alias("n"))
    first = first.orderBy(F.desc(metric), "s0").offset(offset).limit(limit).join(F.broadcast(n))
    first = first.withColumn("rnk", offset + F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(metric), "s0")))  # ``limit`` rows
    top = F.concat(F.lit(path + "/"), "s0")
    one = first.select(F.lit(1).alias("level"), top.alias("path"), F.lit(path).alias("parent_path"), "pv", "v", "has_children", "rnk", "n")
    if depth < 2:
        return one
    best = Window.partitionBy("s0").orderBy(F.desc(metric), "s1")
    second = cells.where("s1 <> ''").join(F.broadcast(first.select("s0", "below")), "s0")
    second = second.withColumn("rnk", F.row_number().over(best)).where(F.col("rnk") <= limit)
    two = second.select(
        F.lit(2).alias("level"), F.concat(top, F.lit("/"), "s1").alias("path"), top.alias("parent_path"), "pv", "v", F.col("deep").alias("has_children"), "rnk", F.col("below").alias("n")
    )
    return one.unionByName(two)


def page_rows(cube: DataFrame) -> DataFrame:
    """(site_id, datum, parent, segment, pv, v, below): for each day every page and folder under its parent path,
    with the sums of all below it, and how many rows of the cube go deeper.

    A page stands once under each of its ancestors, so the subtrees of a path are the rows of one parent.
    All three numbers add up over days.
    """
    parts = F.split("dimkey", "/", -1)
    step = lambda i: F.struct(
        F.array_join(F.slice(parts, F.lit(1), i), "/").alias("parent"),
        F.element_at(parts, i + 1).alias("segment"),
        (F.array_join(F.slice(parts, i + 2, F.size(parts)), "/") != "").cast("bigint").alias("below"),
    )
    urls = cube.where((F.col("dim") == TREE_DIM) & F.col("dimkey").contains("/"))
    steps = urls.select("site_id", "datum", "pv", "v", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), step)).alias("x")).select("site_id", "datum", "pv", "v", "x.*")
    rows = steps.where("segment <> ''").groupBy("site_id", "datum", "parent", "segment")
    return rows.agg(F.sum("pv").alias("pv"), F.sum("v").alias("v"), F.sum("below").alias("below"))


def _subtrees(pages: DataFrame, site: int, day_from: str, day_to: str) -> DataFrame:
    """(parent, segment, pv, v, has_children) over the days."""
    sums = days(pages, site, day_from, day_to).groupBy("parent", "segment").agg(F.sum("pv").alias("pv"), F.sum("v").alias("v"), (F.sum("below") > 0).alias("has_children"))
    return sums


def stored_tree_children(pages: DataFrame, site: int, day_from: str, day_to: str, path: str = "", metric: str = "pv", limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """``url_tree_children`` from rows of ``page_rows``: reads those of one parent only."""
    limit, offset = check_page(metric, limit, offset)
    sums = _subtrees(pages.where(F.col("parent") == path), site, day_from, day_to)
    every = Window.partitionBy("parent")
    page = sums.withColumn("n", F.count("*").over(every)).orderBy(F.desc(metric), "segment").offset(offset).limit(limit)
    return page.select("segment", F.concat(F.lit(path + "/"), "segment").alias("path"), "pv", "v", "has_children", "n")


def stored_tree(pages: DataFrame, site: int, day_from: str, day_to: str, path: str = "", metric: str = "pv", limit: int = DEFAULT_LIMIT, offset: int = 0, depth: int = 2) -> DataFrame:
    """``url_tree`` from rows of ``page_rows``: the subtrees of ``path`` first, then those of the ones shown."""
    first = stored_tree_children(pages, site, day_from, day_to, path, metric, limit, offset)
    first = first.withColumn("rnk", offset + F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(metric), "segment")))  # ``limit`` rows
    one = first.select(F.lit(1).alias("level"), "path", F.lit(path).alias("parent_path"), "pv", "v", "has_children", "rnk", "n")
    if depth < 2:
        return one
    shown = [r.path for r in first.where("has_children").select("path").collect()]  # ``limit`` paths
    if not shown:
        return one
    best, every = Window.partitionBy("parent").orderBy(F.desc(metric), "segment"), Window.partitionBy("parent")
    two = _subtrees(pages.where(F.col("parent").isin(shown)), site, day_from, day_to)
    two = two.withColumns({"rnk": F.row_number().over(best), "n": F.count("*").over(every)}).where(F.col("rnk") <= limit)
    return one.unionByName(
        two.select(F.lit(2).alias("level"), F.concat("parent", F.lit("/"), "segment").alias("path"), F.col("parent").alias("parent_path"), "pv", "v", "has_children", "rnk", "n")
    )
