"""Log streams and the incremental import."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hitloom.plans import metrics, rollups
from hitloom.plans.beside import at_once
from hitloom.plans.importing import ImportConfig, import_sites, parsed_hits
from hitloom.plans.tables import Tables, rebuild_meta, rebuild_topn
from hitloom.sources.growing import stream_log_files

MARGIN = "60 seconds"
GAP = "30 minutes"


def stream_lines(spark: SparkSession, sites: dict[int, str] | str, site_id: int = 1) -> DataFrame:
    """(site_id, rid, file, byte, line) of growing files, each line once: those of one site, or of many
    as {site_id: path or pattern}.  See ``sources.growing``."""
    named = {site_id: sites} if isinstance(sites, str) else sites
    return stream_log_files(spark, named).select("site_id", "rid", "file", "byte", "line")


def stream_new_files(spark: SparkSession, path: str, site_id: int = 1) -> DataFrame:
    """The same of whole files that arrive in a folder of any store that Spark reads, packed ones too.
    Files that were read are not looked at again; ``byte`` is null, and ``rid`` has no order."""
    lines = spark.readStream.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")).where(F.length("line") > 0)
    return lines.select(F.lit(site_id).cast("int").alias("site_id"), F.xxhash64("line").alias("rid"), "file", F.lit(None).cast("bigint").alias("byte"), "line")


def stream_hits(spark: SparkSession, path: dict[int, str] | str, config: ImportConfig | None = None, site_id: int = 1) -> DataFrame:
    """Clean, classified hits of arriving files."""
    return parsed_hits(stream_lines(spark, path, site_id), config or ImportConfig())


def stream_sessions(hits: DataFrame, watermark: str = MARGIN, gap: str = GAP) -> DataFrame:
    """(site_id, vkey, started, ended, pageviews): a visit comes out once the watermark has passed
    its end by ``gap``, so the last open ones wait.  The streaming twin of ``sessionize``."""
    rows = hits.where(F.col("status") < 400).withWatermark("ts", watermark)
    groups = rows.groupBy(F.session_window("ts", gap).alias("w"), "site_id", "vkey")
    found = groups.agg(F.count("*").alias("pageviews"), F.min("ts").alias("started"), F.max("ts").alias("ended"))
    return found.select("site_id", "vkey", "started", "ended", "pageviews")


def stream_buckets(hits: DataFrame, tz: str = "UTC", width: str = "1 hour", watermark: str = MARGIN) -> DataFrame:
    """(site_id, bucket, pageviews, bytes) by hours or days of the site's clock."""
    local = hits.where(F.col("status") < 400).withColumn("ts_local", F.from_utc_timestamp("ts", tz)).withWatermark("ts_local", watermark)
    found = local.groupBy("site_id", F.window("ts_local", width).alias("w")).agg(F.count("*").alias("pageviews"), F.sum("bytes").alias("bytes"))
    return found.select("site_id", F.col("w.start").alias("bucket"), "pageviews", "bytes")


def days_to_build(built: DataFrame, today: str, lookback: int) -> DataFrame:
    """(datum) of the days still to build, from the last built one to yesterday.

    Yesterday is always among them; a first run looks back ``lookback`` days.  ``built``: datum.
    """
    yesterday = F.date_sub(F.lit(today).cast("date"), 1)
    last = built.agg(F.max("datum").alias("last"))
    first_run = F.date_sub(yesterday, lookback - 1)
    start = F.when(F.col("last").isNull(), first_run).otherwise(F.least(F.date_add("last", 1), yesterday))
    spine = last.select(F.explode(F.sequence(start, yesterday)).alias("datum"))
    return spine.join(built.where(F.col("datum") != yesterday).select("datum").distinct(), "datum", "left_anti")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream of a checkpoint when it first started."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first().value)["id"]


LANDED = "rid bigint, file string, byte bigint, line string, stream string, batch bigint, site_id int, datum date"


def landed_lines(tables: Tables, days: list[tuple[int, datetime.date]]) -> DataFrame:
    """(site_id, rid, line) that all streams have landed for these days.

    A stretch that several streams have read, as after a lost checkpoint, counts once: a line is known
    by its file and its place there.
    """
    store = f"{tables.folder}/lines"
    stored = tables.spark.read.schema(LANDED).option("basePath", store)
    mine = stored.parquet(*[f"{store}/stream=*/batch=*/site_id={s}/datum={d.isoformat()}" for s, d in days])
    placed = mine.where("byte IS NOT NULL").dropDuplicates(["site_id", "datum", "file", "byte", "line"])
    return placed.unionByName(mine.where("byte IS NULL")).select("site_id", "rid", "line")


def start_import(lines: DataFrame, tables: Tables, checkpoint: str, cutoff: Callable[[], str], config: ImportConfig | None = None) -> StreamingQuery:
    """Imports arriving lines of any number of sites until none are left, then stops.

    A batch lands in a table of lines by site and day, under the id of its stream and its own number,
    so a replayed batch replaces itself and no other stream's, nor one of an earlier checkpoint.  Then every
    complete day (before ``cutoff()``, on the site's clock) that the batch touched, or that still waits, is
    rebuilt whole from the lines of that day: late lines change it, and replays change nothing.  Which
    days there are is read from folder names.  A day that was built leaves a mark, as one of failed
    requests alone has no row in any table.  Visitor keys change with the day.  Each batch has a row in ``runs``.
    """
    base = config or ImportConfig()
    config = ImportConfig(**{**base.__dict__, "salt_by": "day", "cutoff": None, "day_from": None, "day_to": None})
    store, marks = f"{tables.folder}/lines", f"{tables.folder}/built"

    def land(batch: DataFrame, number: int) -> None:
        stream = stream_id(batch.sparkSession, checkpoint)
        with metrics.recorded(tables, "batch", f"{stream}/{number}") as run:
            take(run.watch(batch.withColumn("nbytes", F.octet_length("line") + 1), "nbytes"), f"{store}/stream={stream}/batch={number}")

    def take(batch: DataFrame, landed: str) -> None:
        spark = batch.sparkSession
        kept = parsed_hits(batch.withColumn("raw", F.col("line")), config)
        kept = kept.select("rid", "file", "byte", F.col("raw").alias("line"), "site_id", "datum").where("site_id IS NOT NULL AND datum IS NOT NULL")
        kept.write.mode("overwrite").partitionBy("site_id", "datum").parquet(landed)
        limit = datetime.date.fromisoformat(cutoff())
        built = {*tables.partitions("daily"), *tables.partitions("daily", marks)}
        waiting = set(tables.partitions("daily", f"{store}/stream=*/batch=*")) - built
        due = sorted(x for x in waiting.union(tables.partitions("daily", landed)) if x[1] < limit)
        if not due:
            return
        found = import_sites(landed_lines(tables, due), config).persist()
        cube, daily = found.cube(), found.daily()
        rollups.note(tables, due)
        sites = spark.createDataFrame([(s, str(s)) for s in sorted({s for s, _ in due})], "site_id int, site string")

        def days_and_meta() -> None:
            tables.write("daily", daily)
            rebuild_meta(tables, sites, config.tz)

        tables.write("cube", cube)
        with at_once(tables.spark) as beside:
            beside(days_and_meta)
            if rollups.kept(tables):
                rollups.refresh(tables, due)
            else:
                rollups.build(tables)
        found.unpersist()
        rebuild_topn(tables, sites)
        tables.mark_days(marks, due)

    writer = lines.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
