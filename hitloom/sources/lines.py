"""Log lines and their formats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("ip", "tsraw", "method", "url", "status", "size", "referrer", "ua")

# The line formats and the paths of the JSON format.
COMBINED = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) [^"]*" (\d+) (\d+) "([^"]*)" "([^"]*)"'
COMBINED_VHOST = r'^\S+:\d+ (\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) [^"]*" (\d+) (\d+) "([^"]*)" "([^"]*)"'
COMMON = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) [^"]*" (\d+) (\d+)'
LOG_TIME = "%d/%b/%Y:%H:%M:%S %z"
SEPARATOR = "\x01"
JSON_TIME = "%Y-%m-%dT%H:%M:%S%z"
JSON_PATHS = (
    "$.client.ip",
    "$.@timestamp",
    "$.http.request.method",
    "$.HTTP.url_path",
    "$.http.response.status_code",
    "$.http.response.bytes",
    "$.HTTP.req.referer",
    "$.user_agent.original",
)


@dataclass(frozen=True)
class LogFormat:
    """A line pattern with a group for each field (missing ones are empty), or JSON lines."""

    name: str
    ts_format: str
    pattern: str | None = None


FORMATS = {
    "combined": LogFormat("combined", LOG_TIME, COMBINED),
    "combined_vhost": LogFormat("combined_vhost", LOG_TIME, COMBINED_VHOST),
    "common": LogFormat("common", LOG_TIME, COMMON),
    "json_ecs": LogFormat("json_ecs", JSON_TIME),
}


def log_format(name: str = "combined", regex: str | None = None, ts_format: str | None = None) -> LogFormat:
    """A built-in format, or ``custom`` with its own pattern of eight groups and time format."""
    if name == "custom":
        if not regex or not ts_format:
            raise ValueError("custom needs a regex of 8 groups and a time format")
        if (groups := count_groups(regex)) != len(FIELDS):
            raise ValueError(f"the regex has {groups} groups instead of {len(FIELDS)}")
        return LogFormat("custom", ts_format, regex)
    if name not in FORMATS:
        raise ValueError(f"unknown log format {name!r}; known: {', '.join([*FORMATS, 'custom'])}")
    return FORMATS[name]


def count_groups(regex: str) -> int:
    """Number of capturing groups of a pattern."""
    n, i, inside = 0, 0, False
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside, i = True, i + (regex[i + 1 : i + 2] == "]") + 2 * (regex[i + 1 : i + 3] == "^]")
        elif c == "(" and (regex[i + 1 : i + 2] != "?" or regex[i + 1 : i + 3] in ("?P", "?<") and regex[i + 3 : i + 4] not in ("=", "!")):
            n += 1
        i += 1
    return n


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(rid, line, nbytes, file) of text files of any store, packed or not; blank lines are left out.

    ``rid`` orders lines by file and by their place in it, however files are split: by the byte at
    which a split begins, and by the number of the line within the split.  Where files are mounted,
    ``sources.growing.read_log_files`` gives the very byte of each line.
    """
    rows = spark.read.text(path).where(F.length("value") > 0)
    place = F.struct(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")
    )
    return rows.select(place.alias("rid"), F.col("value").alias("line"), (F.octet_length("value") + 1).cast("long").alias("nbytes"), F.col("_metadata.file_path").alias("file"))


def parse_lines(lines: DataFrame, fmt: str = "combined", regex: str | None = None, ts_format: str | None = None, line: str = "line") -> DataFrame:
    """Replaces the line by its eight text fields; other columns stay.

    A line that does not fit a pattern gives empty fields, which fall out later as they have no
    time.  Lines that are no JSON are skipped at once; JSON of another shape gives nulls.
    """
    chosen = log_format(fmt, regex, ts_format)
    text, rest = F.col(line), [c for c in lines.columns if c != line]
    if chosen.pattern is None:
        lines = lines.where(F.try_parse_json(text).isNotNull())
        fields = [F.get_json_object(text, path) for path in JSON_PATHS]
    else:
        n = count_groups(chosen.pattern)
        # A generator of one row: filters on a field stay above it, so no match is repeated for them.
        lines = lines.select(*rest, line, F.explode(F.array(_matched(text, chosen.pattern, n))).alias("matched"))
        whole = F.size("matched") == n
        fields = [F.when(whole, F.get("matched", F.lit(i))).otherwise(F.regexp_extract(text, chosen.pattern, i + 1)) for i in range(n)]
        fields += [F.lit("")] * (len(FIELDS) - n)
    return lines.select(*rest, *[f.alias(name) for f, name in zip(fields, FIELDS, strict=True)])


def _matched(text: Column, pattern: str, n: int) -> Column:
    """The groups of the first match, found by one match that writes them with a separator between.

    A line without a match, or with the separator in it, gives another number of parts.
    """
    joined = F.regexp_replace(text, f"^(?s:.*?)(?:{pattern})(?s:.*)$", SEPARATOR.join(f"${i + 1}" for i in range(n)))
    return F.split(joined, SEPARATOR, -1)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, logfile, name) of a tab-separated site list; ``#`` lines and blank ones are skipped."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    part = F.split("value", "\t")
    rows = rows.select(F.trim(F.get(part, F.lit(0))).try_cast("int").alias("site_id"), F.trim(F.get(part, F.lit(1))).alias("logfile"), F.trim(F.get(part, F.lit(2))).alias("name"))
    return rows.where(F.col("site_id").isNotNull() & F.col("logfile").isNotNull())
