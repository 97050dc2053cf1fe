"""Browser and system from pattern lists, in place of the built-in rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.functions.agents import windows_version
from hitloom.sources.lists import LIST_LIMIT

# What must stand before a pattern of the lists.
BOUNDARY = r"(?i)(?:^|[^A-Z0-9_-]|[^A-Z0-9-]_|sprd-|MZ-)(?:"


def bounded_pattern(pattern: Column) -> Column:
    """The list pattern at a word boundary, whatever the case.  Two empty groups at its end let
    templates name groups that the pattern lacks."""
    return F.concat(F.lit(BOUNDARY), pattern, F.lit(")()()"))


def filled_version(ua: Column, pattern: Column, template: Column) -> Column:
    """The template with ``$1`` and ``$2`` replaced by the groups, trimmed of spaces and dots."""
    out = F.coalesce(template, F.lit(""))
    for n in (1, 2):
        group = F.call_function("regexp_extract", ua, pattern, F.lit(n))
        out = F.when(out.contains(f"${n}"), F.replace(out, F.lit(f"${n}"), group)).otherwise(out)
    return F.btrim(out, F.lit(" ."))


#: Letters of the pieces by which patterns are looked up.
GRAM = 3


def required_grams(regex: str) -> list[str] | None:
    """Pieces of ``GRAM`` lower-case letters, one of which every text has that the pattern matches; None if none is sure.

    Letters in a row that must stand in a match give one piece, that in their middle; alternatives give
    one each.  Only plain ASCII counts, and a pattern that Python's parser does not know has none.
    """

    def runs(parts) -> list[list[str]]:
        """What is sure to stand in a match: each entry lists strings of which one does."""
        found, letters = [], ""

        def close() -> None:
            nonlocal letters
            if len(letters) >= GRAM:
                found.append([letters])
            letters = ""

        for kind, value in parts:
            name = str(kind)
            if name == "LITERAL" and value < 128:
                letters += chr(value).lower()
                continue
            if name == "SUBPATTERN" and [str(k) for k, _ in value[3]] == ["LITERAL"] * len(value[3]) and all(v < 128 for _, v in value[3]):
                letters += "".join(chr(v).lower() for _, v in value[3])
                continue
            close()
            if name == "SUBPATTERN":
                found += runs(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                found += runs(value[2])
            elif name == "ATOMIC_GROUP":
                found += runs(value)
            elif name == "BRANCH":
                sides = [runs(side) for side in value[1]]
                if all(sides):
                    found.append([x for side in sides for x in best(side)])
        close()
        return found

    def best(found: list[list[str]]) -> list[str]:
        return min(found, key=lambda x: (len(x), -min(map(len, x))))

    if "&&" in regex or "\\0" in regex:  # Java reads these in its own way
        return None
    try:
        sure = runs(_parser.parse(regex))
    except (re.error, OverflowError, RecursionError):
        return None
    if not sure:
        return None
    middle = lambda x: x[(len(x) - GRAM) // 2 :][:GRAM]
    return sorted({middle(x) for x in best(sure)})


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = [required_grams(r) if r is not None else [] for r in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.string()))], names=["regex", "grams"])


def pattern_candidates(agents: DataFrame, patterns: DataFrame) -> DataFrame:
    """(ua, prio, regex, name, version): the patterns that an agent may match, a row for each.

    Each pattern stands in an index under pieces that its matches must hold; an agent is looked up
    with all its pieces, and only what it meets there is left for the regular expression.  Patterns without
    a sure piece stand under '', which every agent has.
    """
    regexes = patterns.select("regex").distinct().mapInArrow(_keyed, "regex string, grams array<string>")
    keys = F.explode(F.coalesce("grams", F.array(F.lit(""))))
    index = patterns.join(regexes, "regex").select("prio", "regex", "name", "version", keys.alias("gram"))
    low, n = F.lower("ua"), F.length(F.lower("ua"))
    places = F.when(n >= GRAM, F.sequence(F.lit(1), n - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    grams = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM)))))
    pieces = agents.select("ua", F.explode(grams).alias("gram"))
    return pieces.join(F.broadcast(index), "gram").drop("gram").distinct()


def _first_match(agents: DataFrame, patterns: DataFrame, name: str, version: str) -> DataFrame:
    """(ua, name, version) of the first pattern by priority that matches, among the candidates of distinct agents.
    The length of the list is checked, as it goes to all tasks."""
    if patterns.limit(LIST_LIMIT + 1).count() > LIST_LIMIT:
        raise ValueError(f"a list has at most {LIST_LIMIT} patterns")
    met = pattern_candidates(agents, patterns).withColumn("pattern", bounded_pattern(F.col("regex"))).where(F.rlike(F.col("ua"), F.col("pattern")))
    first = met.groupBy("ua").agg(F.min_by(F.struct("name", "pattern", "version"), F.struct("prio", "regex")).alias("m"))
    return first.select("ua", F.col("m.name").alias(name), filled_version(F.col("ua"), F.col("m.pattern"), F.col("m.version")).alias(version))


def ua_lookup(hits: DataFrame, browsers: DataFrame, oses: DataFrame) -> DataFrame:
    """(ua, browser, browser_ver, os, os_ver) of the distinct user agents of the hits.

    An agent that only one list knows has nulls from the other, but for ``browser_ver``, which
    is then ''.
    """
    agents = hits.select("ua").where(F.col("ua").isNotNull() & ~F.col("ua").isin("", "-")).distinct()
    found = agents.join(_first_match(agents, browsers, "browser", "browser_ver"), "ua", "left")
    found = found.join(_first_match(agents, oses, "os", "version"), "ua", "left")
    release = F.when((F.col("os") == "Windows") & (F.col("version") != ""), windows_version(F.col("version"))).otherwise(F.col("version"))
    return found.select(
        "ua",
        "browser",
        F.coalesce("browser_ver", F.lit("")).alias("browser_ver"),
        "os",
        F.when(F.col("os").isNotNull(), F.trim(F.concat_ws(" ", "os", release))).alias("os_ver"),
    )


def apply_ua_lookup(hits: DataFrame, lookup: DataFrame) -> DataFrame:
    """Overrides each of the four columns where the lookup knows better."""
    names = ("browser", "browser_ver", "os", "os_ver")
    known = lookup.select("ua", *[F.col(n).alias(f"listed_{n}") for n in names])
    joined = hits.join(known, "ua", "left")
    return joined.withColumns({n: F.coalesce(F.col(f"listed_{n}"), F.col(n)) for n in names}).drop(*[f"listed_{n}" for n in names])
