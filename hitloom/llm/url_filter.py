"""URL filter rules by host suffix and path prefix, found through hashed expressions.

Each URL is expanded into the expressions that some rule could equal: host suffixes by
number of labels, path prefixes by length, in the shapes that the rule table has.  The
expressions meet the rules on a short prefix of their digests; the full digest, taken of host and
path with a byte between that no host holds, confirms, and the longest rule wins.  DataFrame functions only.

A page meets at most one rule of a shape.  So where the rules have few shapes and may be broadcast, each
shape is one equi-join that adds columns to the pages in place, and nothing is shuffled.  Otherwise
the distinct URLs are expanded, and the rules found come back by the URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that may be broadcast: about 10 MB.  A longer table is joined by shuffle.
BROADCAST_RULES = 50_000
#: Shapes of rules that are joined one after the other.
FEW_SHAPES = 16
#: Stands between host and path in a digest; no host that a URL has can hold it.
BETWEEN = "/"
PREFIX_DIGITS = 8


def url_rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null and for URLs without it."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def url_host(url: Column) -> Column:
    """Host with port, A-Z lower-cased: up to the first ``/``, ``?`` or ``#``."""
    return F.translate(F.regexp_extract(url_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """Path: from the end of the host up to ``?`` or ``#``."""
    return F.regexp_extract(url_rest(url), "^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` (host and path of the rule, else null) and
    ``verdict`` (the rule's, else ``default``).  ``rules``: host, path, verdict.

    A rule fits its host and all subdomains, where the path starts with its own.  The longest
    rule wins, then the longer host; of equal rules a block wins.  Rules with nulls, an empty host
    or a host with ``/``, ``?`` or ``#`` never fit; null URLs have empty hosts.  Columns of the
    pages stay, in any number; those named like the new ones are replaced.  URLs may be of any length.
    """
    rules = rules.dropna(subset=["host", "path", "verdict"]).where("host <> ''").where(~F.col("host").rlike("[/?#]"))
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = rules.select(
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("path_length"),
        F.sha2(F.concat("host", F.lit(BETWEEN), "path"), 256).alias("rule_digest"),
        F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("host_length"), F.concat("host", "path").alias("rule"), "verdict").alias("found"),
    )
    known = materialize(known.withColumn("short", F.left("rule_digest", F.lit(PREFIX_DIGITS))), "rules")
    shapes = sorted(tuple(r) for r in known.select("labels", "path_length").distinct().collect())
    parsed = pages.drop("rule", "verdict").withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    if known.count() <= BROADCAST_RULES and len(shapes) <= FEW_SHAPES:
        judged = parsed
        for i, (labels, length) in enumerate(shapes):
            own = known.where((F.col("labels") == labels) & (F.col("path_length") == length))
            own = own.select(F.col("short").alias("__short"), F.col("rule_digest").alias("__confirm"), F.col("found").alias(f"__found{i}"))
            digest = F.when(_fits(F.lit(labels), F.lit(length)), _digest(F.lit(labels), F.lit(length)))
            judged = judged.withColumn("__digest", digest)
            met = (F.left("__digest", F.lit(PREFIX_DIGITS)) == F.col("__short")) & (F.col("__digest") == F.col("__confirm"))
            judged = judged.join(F.broadcast(own), met, "left").drop("__short", "__confirm", "__digest")
        found = [F.col(f"__found{i}") for i in range(len(shapes))]
        best = F.greatest(*found) if len(found) > 1 else (found or [F.lit(None).cast(known.schema["found"].dataType)])[0]
        judged = judged.withColumn("__best", best).drop(*[f"__found{i}" for i in range(len(shapes))])
    else:
        listed = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(m).alias("path_length")) for n, m in shapes])
        shape = F.explode(F.filter(listed, lambda s: _fits(s["labels"], s["path_length"])))
        urls = parsed.select(F.col(url).alias("__url"), "host", "path").distinct()
        expanded = urls.select("__url", "host", "path", shape.alias("s")).select("__url", _digest(F.col("s.labels"), F.col("s.path_length")).alias("digest"))
        side = F.broadcast(known) if known.count() <= BROADCAST_RULES else known
        met = expanded.join(side, F.left("digest", F.lit(PREFIX_DIGITS)) == F.col("short")).where("digest = rule_digest")
        best = materialize(met.groupBy("__url").agg(F.max("found").alias("__best")), "matched-urls")
        judged = parsed.join(best, parsed[url] == best["__url"], "left").drop("__url")
    return judged.withColumns({"rule": F.col("__best.rule"), "verdict": F.coalesce("__best.verdict", F.lit(default))}).drop("__best")


def _fits(labels: Column, length: Column) -> Column:
    return (labels <= F.size(F.split("host", r"\."))) & (length <= F.length("path"))


def _digest(labels: Column, length: Column) -> Column:
    """Digest of the last labels of the host and the first characters of the path."""
    suffix = F.array_join(F.slice(F.split("host", r"\."), -labels, labels), ".")
    return F.sha2(F.concat(suffix, F.lit(BETWEEN), F.left("path", length)), 256)
