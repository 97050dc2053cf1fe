"""Import of logs: one job from raw lines to cube rows, for any number of sites."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.functions import requests
from hitloom.functions.agents import is_bot
from hitloom.operators import agents, cube, geo, hits, sessions
from hitloom.sources.lines import log_format, parse_lines


@dataclass(frozen=True)
class ImportConfig:
    """How lines are read and classified.

    ``salt_by`` is ``batch``, where visits run over midnight within a batch, or ``day``, where the
    visitor key changes with the day.  ``mask`` names query parameters to mask, ``truncate``
    cuts the last part of addresses; both act before anything is hashed or counted.
    """

    fmt: str = "combined"
    regex: str | None = None
    ts_format: str | None = None
    tz: str = "UTC"
    salt: str = "salt"
    salt_by: str = "batch"
    bot_pattern: str | None = None
    bot_filter: bool = True
    download_pattern: str | None = None
    day_from: str | None = None
    day_to: str | None = None
    cutoff: str | None = None
    geo: DataFrame | None = None
    geo6: DataFrame | None = None
    browsers: DataFrame | None = None
    oses: DataFrame | None = None
    mask: tuple[str, ...] = ()
    truncate: bool = False


@dataclass(frozen=True)
class Analysis:
    """The relations of an import."""

    hits_all: DataFrame
    sess: DataFrame
    visits: DataFrame

    def daily(self) -> DataFrame:
        return cube.daily(self.sess, self.visits)

    def cube(self) -> DataFrame:
        return cube.cube_rows(self.sess, self.visits, self.hits_all)

    def totals(self) -> DataFrame:
        return cube.batch_totals(self.sess, self.visits)

    def persist(self) -> Analysis:
        """Keeps the relations that several results read; what memory cannot hold goes to disk."""
        for rows in (self.hits_all, self.sess, self.visits):
            rows.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        for rows in (self.hits_all, self.sess, self.visits):
            rows.unpersist()


def parsed_hits(lines: DataFrame, config: ImportConfig) -> DataFrame:
    """Clean, classified hits of every status from (site_id, rid, line).

    The classification makes one long generated method, which HotSpot would never compile; at this
    limit Spark generates shorter ones, which took a third of the time.
    """
    lines.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    chosen = log_format(config.fmt, config.regex, config.ts_format)
    rows = parse_lines(lines, config.fmt, config.regex, config.ts_format)
    if config.mask:
        rows = rows.withColumns({c: requests.mask_query_params(F.col(c), list(config.mask)) for c in ("url", "referrer")})
    if config.truncate:
        rows = rows.withColumn("ip", requests.truncate_ip(F.col("ip")))
    rows = hits.drop_assets(rows).withColumn("low", F.lower("ua"))
    rows = hits.worked_out(
        rows,
        ts=requests.parse_time(F.col("tsraw"), config.ts_format or chosen.ts_format),
        status=F.col("status").try_cast("int"),
        is_bot=is_bot(F.col("ua"), config.bot_pattern, config.bot_filter, F.col("low")),
    ).drop("low")
    rows = hits.with_local_times(hits.clean_hits(rows), config.tz)
    rows = hits.within_days(rows, config.day_from, config.day_to, config.tz)
    if config.cutoff:
        rows = hits.before_day(rows, config.cutoff, config.tz)
    salt = F.concat(F.lit(config.salt), F.col("datum").cast("string")) if config.salt_by == "day" else config.salt
    return hits.tell(hits.with_status_bytes(rows), salt, config.download_pattern)


#: What visits and cube need of a hit; what an agent tells is told of visits, which are fewer.
KEPT = ("site_id", "rid", "ts", "datum", "stunde", "vkey", "ip", "ipint", "ua", "method", "url", "is_download", "status", "bytes", "referrer", "keyword")


def analyse_hits(hits_all: DataFrame, config: ImportConfig) -> Analysis:
    """Visits of clean hits."""
    hits_all = hits_all.select(*KEPT)
    good = hits.successful(hits_all)
    listed = agents.ua_lookup(good, config.browsers, config.oses) if config.browsers is not None and config.oses is not None else None
    sess = sessions.sessionize(good)
    found = sessions.visits(sess, listed=listed)
    v4 = geo.ip_country(good, config.geo) if config.geo is not None else None
    v6 = geo.ip6_country(good, config.geo6) if config.geo6 is not None else None
    return Analysis(hits_all, sess, geo.with_country(found, v4, v6))


def import_sites(lines: DataFrame, config: ImportConfig | None = None) -> Analysis:
    """Analysis of (site_id, rid, line): the site is a key like any other, so all sites of an
    import share one job."""
    config = config or ImportConfig()
    return analyse_hits(parsed_hits(lines, config), config)
