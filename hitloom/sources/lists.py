"""Pattern lists: bots, browsers and systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns that one list may have: they are joined into one pattern or sent to every task.
LIST_LIMIT = 20_000


def read_bot_list(spark: SparkSession, path: str) -> str:
    """One case-blind pattern that matches what any line of the list does.

    Blank lines and ``#`` lines are skipped.  Raises if nothing is left or the list is too long.
    """
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    found = [r.value for r in rows.limit(LIST_LIMIT + 1).collect()]
    if not 0 < len(found) <= LIST_LIMIT:
        raise ValueError(f"a bot list has 1 to {LIST_LIMIT} patterns, not {len(found)}")
    return "(?i)" + "|".join(f"({p})" for p in found)


def read_ua_list(spark: SparkSession, path: str) -> DataFrame:
    """(prio, regex, name, version) of a tab-separated list; rows without priority or pattern and
    patterns that start with ``#`` are skipped."""
    rows = spark.read.csv(path, sep="\t", schema="prio int, regex string, name string, version string", quote="", escape="")
    return rows.where(F.col("prio").isNotNull() & F.col("regex").isNotNull() & ~F.col("regex").startswith("#"))
