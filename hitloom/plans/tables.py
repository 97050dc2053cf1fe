"""The stored tables and what changes them."""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hitloom.functions.rules import first_rule
from hitloom.operators.cube import CUBE, DAILY, site_meta
from hitloom.operators.panels import best_by_window
from hitloom.operators.windows import cube_by_window, preset_windows
from hitloom.plans import rollups

SCHEMA_VERSION = 2
SCHEMAS = {
    "cube": "site_id int, datum date, dim string, parent string, dimkey string, pv bigint, v bigint",
    "daily": "site_id int, datum date, visits bigint, pageviews bigint, uniques bigint, bounces bigint, bytes bigint",
    "meta": "site_id int, site string, von string, bis string, visits_total bigint, pageviews_total bigint, uniques_total bigint, bounces_total bigint, bytes_total bigint, erzeugt string, schema_version int, tz string",
    "topn": "site_id int, win string, dim string, parent string, dimkey string, pv bigint, v bigint, rnk smallint",
}
PARTITIONS = {"cube": ["site_id", "datum"], "daily": ["site_id", "datum"], "meta": ["site_id"], "topn": ["site_id"]}
# Tables made of the cube for faster reading, of which a copy for serving has no need, and what runs did.
OWN_SCHEMAS = {
    "nodes": "site_id int, level int, node int, dim string, parent string, dimkey string, pv bigint, v bigint",
    "pages": "site_id int, datum date, parent string, segment string, pv bigint, v bigint, below bigint",
    "ranked": "site_id int, level int, node int, head boolean, dim string, parent string, dimkey string, measure bigint",
    "codes": "site_id int, dim string, dimkey string, code bigint",
    "bitmaps": "site_id int, datum date, dim string, parent string, bucket bigint, bits binary, pv bigint, v bigint",
    "runs": "day date, run string, started timestamp, ended timestamp, kind string, status string, rows bigint, bytes bigint, message string",
}
OWN_PARTITIONS = {
    "nodes": ["site_id", "level", "node"],
    "pages": ["site_id", "datum"],
    "ranked": ["site_id", "level", "node"],
    "codes": ["site_id"],
    "bitmaps": ["site_id", "datum"],
    "runs": ["day"],
}


@dataclass(frozen=True)
class Tables:
    """Parquet tables below one folder, partitioned by site and, where they have one, by day."""

    spark: SparkSession
    folder: str
    cube: str = "cube"
    daily: str = "daily"
    meta: str = "meta"
    topn: str = "topn"
    nodes: str = "nodes"
    pages: str = "pages"
    ranked: str = "ranked"
    codes: str = "codes"
    bitmaps: str = "bitmaps"
    runs: str = "runs"

    def path(self, table: str) -> str:
        return f"{self.folder}/{getattr(self, table)}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def read(self, table: str) -> DataFrame:
        """The table, empty before the first write."""
        return self.read_parts(table, [self.path(table)] if self.exists(self.path(table)) else [])

    def read_parts(self, table: str, folders: list[str]) -> DataFrame:
        """The rows of folders of the table, which must be there."""
        schema = (SCHEMAS | OWN_SCHEMAS)[table]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path(table)).parquet(*folders)

    def exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def delete(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    def partitions(self, table: str, folder: str | None = None, site: int | None = None) -> list[tuple[int, datetime.date]]:
        """(site, day) of the stored partitions, or of those staged in ``folder``, from folder names alone."""
        fs, where = self._fs(f"{folder or self.path(table)}/site_id={'*' if site is None else site}/datum=*")
        found = [str(s.getPath().toString()).split("/")[-2:] for s in fs.globStatus(where) or []]
        return [(int(a.split("=")[1]), datetime.date.fromisoformat(b.split("=")[1])) for a, b in found]

    def mark_days(self, folder: str, days: list[tuple[int, datetime.date]]) -> None:
        """Notes days as folders, which ``partitions`` reads."""
        for site, day in days:
            self.mark(f"{folder}/site_id={site}/datum={day.isoformat()}")

    def mark(self, path: str) -> None:
        """Makes the folder if it is not there."""
        fs, where = self._fs(path)
        fs.mkdirs(where)

    def drop_days(self, table: str, days: list[tuple[int, datetime.date]]) -> None:
        for site, day in days:
            self.delete(f"{self.path(table)}/site_id={site}/datum={day.isoformat()}")

    def stage(self, table: str, rows: DataFrame) -> str:
        """Writes the rows beside the table, where no reader sees them; gives the folder."""
        staged = f"{self.folder}/_staged/{table}-{uuid.uuid4().hex}"
        self.write(table, rows, staged)
        return staged

    def move_days(self, table: str, staged: str) -> None:
        """Puts the staged days in place of the stored ones, each by a rename, and drops what is left."""
        for site, day in self.partitions(table, staged):
            part = f"site_id={site}/datum={day.isoformat()}"
            fs, target = self._fs(f"{self.path(table)}/{part}")
            fs.delete(target, True)
            fs.mkdirs(target.getParent())
            if not fs.rename(self._fs(f"{staged}/{part}")[1], target):
                raise OSError(f"{part} of {table} could not be moved; {staged} still has it")
        self.delete(staged)

    def write(self, table: str, rows: DataFrame, path: str | None = None) -> None:
        """Replaces the partitions that the rows have; all others stay.  Rows of a partition are
        gathered and sorted, so readers skip row groups of other dimensions; adaptive execution
        splits a partition that is too large for one task."""
        keys = (PARTITIONS | OWN_PARTITIONS)[table]
        rest = [c for c in ("win", "head", "dim", "parent", "segment") if c in rows.columns]
        rest += [F.desc("measure")] if "measure" in rows.columns else []
        rest += ["dimkey"] if "dimkey" in rows.columns else []
        columns = [F.col(f.split(" ")[0]).cast(f.split(" ")[1]) for f in (SCHEMAS | OWN_SCHEMAS)[table].split(", ")]
        rows = rows.select(*columns).hint("rebalance", *keys).sortWithinPartitions(*keys, *rest)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path or self.path(table))

    def append(self, table: str, rows: DataFrame) -> None:
        """Adds the rows to the table's partitions."""
        keys = (PARTITIONS | OWN_PARTITIONS)[table]
        rows.hint("rebalance", *keys).write.mode("append").partitionBy(*keys).parquet(self.path(table))


def replace_days(tables: Tables, cube_rows: DataFrame, daily_rows: DataFrame, site: int | None = None, day_from: str | None = None, day_to: str | None = None) -> None:
    """Stores a batch in place of the days it covers.

    The range is the one given, or for each site of the batch its first to its last day.  Days of
    the range that the batch lacks are cleared, everything outside stays.  Storing a batch twice
    gives what storing it once does.  With an explicit range and an empty batch a stretch is undone.
    """
    mine = lambda x: x if site is None else x.where(F.col("site_id") == site)
    batch = {"cube": mine(cube_rows), "daily": mine(daily_rows)}
    # Each relation runs once; nothing stored changes before both are staged whole.
    staged = {name: tables.stage(name, rows) for name, rows in batch.items()}
    fresh = {name: set(tables.partitions(name, folder)) for name, folder in staged.items()}
    ranges: dict[int, tuple[datetime.date, datetime.date]] = {}
    for s, d in fresh["cube"] | fresh["daily"]:
        low, high = ranges.get(s, (d, d))
        ranges[s] = (min(low, d), max(high, d))
    if day_from is not None:
        if site is None and not ranges:
            raise ValueError("an empty batch needs a site")
        named = (datetime.date.fromisoformat(day_from), datetime.date.fromisoformat(day_to or day_from))
        ranges = {s: named for s in ([site] if site is not None else ranges)}
    stale = {name: [(s, d) for s, d in tables.partitions(name) if s in ranges and ranges[s][0] <= d <= ranges[s][1] and (s, d) not in fresh[name]] for name in staged}
    rollups.note(tables, [*fresh["cube"], *stale["cube"]])
    for name, folder in staged.items():
        tables.move_days(name, folder)
        tables.drop_days(name, stale[name])
    if rollups.kept(tables):
        rollups.refresh(tables)


def rebuild_meta(tables: Tables, sites: DataFrame, tz: str = "UTC") -> None:
    """Meta of the given sites from all their stored days."""
    mine = tables.read("daily").join(F.broadcast(sites.select("site_id")), "site_id", "left_semi")
    tables.write("meta", site_meta(mine, sites, tz, SCHEMA_VERSION))


def rebuild_topn(tables: Tables, sites: DataFrame) -> None:
    """Best values of the precomputed presets of the given sites, from nodes where the tables have them."""
    meta = tables.read("meta").join(F.broadcast(sites.select("site_id")), "site_id", "left_semi")
    windows = preset_windows(meta)
    rows = rollups.rows_by_window(tables, windows) if rollups.kept(tables) else cube_by_window(tables.read("cube"), windows)
    tables.write("topn", best_by_window(rows))


def purge(tables: Tables, months: int, today: str, dry_run: bool = False) -> DataFrame:
    """(table, n): rows of days before today less ``months``, which are then dropped.

    Meta stays as it is until the next import.  ``months`` must be a positive whole number.
    """
    if isinstance(months, bool) or not isinstance(months, int) or months < 1:
        raise ValueError(f"months must be a positive whole number, not {months!r}")
    spark = tables.spark
    cutoff = spark.sql("SELECT add_months(CAST(:t AS DATE), -:m) AS c", args={"t": today, "m": months}).first().c
    counts = [(n, tables.read(n).where(F.col("datum") < F.lit(cutoff)).count()) for n in ("cube", "daily")]
    if not dry_run:
        old = {name: [(s, d) for s, d in tables.partitions(name) if d < cutoff] for name, _ in counts}
        rollups.note(tables, old["cube"])
        for name, days in old.items():
            tables.drop_days(name, days)
        for name in ("pages", "bitmaps"):
            tables.drop_days(name, old["cube"])
        if rollups.kept(tables):
            rollups.refresh(tables)
    return spark.createDataFrame(counts, "table string, n bigint")


# Dimensions with a parent, and the names that older tables gave to referrer kinds.
CHILD_DIMS = ("referrer_name", "referrer_url", "browser_version", "os_version", "device_model")
OLD_KINDS = (("Direkt", "direct"), ("Suchmaschine", "search"), ("Soziale Medien", "social"), ("Website", "website"))
SEPARATOR = "\x1f"


def split_legacy_key(cube: DataFrame) -> DataFrame:
    """Keys of older cubes, which held the parent before a separator, as parent and key."""
    old = F.col("dim").isin(*CHILD_DIMS) & F.col("parent").isNull() & F.col("dimkey").contains(SEPARATOR)
    head = F.substring_index("dimkey", SEPARATOR, 1)
    tail = F.substring(F.col("dimkey"), F.length(head) + 2, F.lit(1 << 30))
    return cube.withColumns({"parent": F.when(old, head).otherwise(F.col("parent")), "dimkey": F.when(old, tail).otherwise(F.col("dimkey"))})


def migrate_v1_to_v2(cube: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of the first schema in the second one; those of the second stay as they are."""
    none = F.lit(None).cast("string")
    cube = split_legacy_key(cube if "parent" in cube.columns else cube.withColumn("parent", none))
    neutral = lambda c: first_rule([(F.col(c) == old, new) for old, new in OLD_KINDS], F.col(c))
    cube = cube.withColumns({
        "dimkey": F.when(F.col("dim") == "referrer_type", neutral("dimkey")).otherwise(F.col("dimkey")),
        "parent": F.when(F.col("dim") == "referrer_name", neutral("parent")).otherwise(F.col("parent")),
    })
    tz = F.coalesce(F.nullif(F.col("tz"), F.lit("")), F.lit("UTC")) if "tz" in meta.columns else F.lit("UTC")
    return cube.select(*CUBE), meta.withColumns({"tz": tz, "schema_version": F.lit(SCHEMA_VERSION)})


def run_metrics(rows: DataFrame, name: str, size: str | None = None) -> tuple[DataFrame, Observation]:
    """The rows, and what the next action over them counts: rows and bytes of column ``size``."""
    seen = Observation(name)
    total = F.sum(size) if size else F.lit(0)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(total, F.lit(0)).cast("bigint").alias("bytes")), seen


#: Connections that a copy to a database may hold open at once.
JDBC_WRITERS = 16


def publish_jdbc(tables: Tables, url: str, properties: dict[str, str], site: int | None = None, day_from: str | None = None, day_to: str | None = None) -> None:
    """Copies the four tables to a database for serving: all of them, or those days of one site.

    What the database has of the same site and days goes, and of meta and best values all that it
    has of the site; everything else stays.  Rows first land in tables of their own, beside the
    served ones; one transaction then takes them over.  So a copy that fails changes nothing, and
    one that is repeated gives the same.  Missing tables are made.
    """
    if site is None and (day_from or day_to):
        raise ValueError("days are replaced for one site at a time")
    jvm = tables.spark.sparkContext._jvm
    quoted = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    statements = []
    for name in SCHEMAS:
        target, landed = getattr(tables, name), f"{getattr(tables, name)}_landed"
        wanted = [] if site is None else [("site_id", "=", str(int(site)))]
        if "datum" in PARTITIONS[name]:
            days = [(op, datetime.date.fromisoformat(d)) for op, d in ((">=", day_from), ("<=", day_to)) if d]
            wanted += [("datum", op, f"'{d.isoformat()}'") for op, d in days]
        rows = tables.read(name)
        for column, op, value in wanted:
            rows = rows.where(f"{column} {op} {value}")
        writer = lambda x, mode: x.write.mode(mode).option("numPartitions", JDBC_WRITERS)
        writer(rows.limit(0), "ignore").jdbc(url, target, properties=properties)
        writer(rows, "overwrite").jdbc(url, landed, properties=properties)
        where = " AND ".join(f"{quoted(column)} {op} {value}" for column, op, value in wanted)
        columns = ", ".join(quoted(c) for c in rows.columns)
        statements += [f"DELETE FROM {target}" + (f" WHERE {where}" if where else ""), f"INSERT INTO {target} ({columns}) SELECT {columns} FROM {landed}", f"DROP TABLE {landed}"]
    _in_one_transaction(tables.spark, url, properties, statements)


def _in_one_transaction(spark: SparkSession, url: str, properties: dict[str, str], statements: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    settings = jvm.java.util.Properties()
    for key, value in properties.items():
        settings.setProperty(key, value)
    if "driver" in properties:
        jvm.java.lang.Class.forName(properties["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for text in statements:
            statement.executeUpdate(text)
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def empty_batch(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(cube rows, daily rows) without rows, to undo a stretch with ``replace_days``."""
    cube, daily = (spark.createDataFrame([], SCHEMAS[n]) for n in ("cube", "daily"))
    return cube.select(*CUBE), daily.select(*DAILY)
