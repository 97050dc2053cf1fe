"""Mixing sources to target weights by weighted sampling without replacement.

Efraimidis-Spirakis: each document draws an exponential key with its quality weight as rate,
the keys sort a source, and a prefix sum of sizes fills the budget.  Whole epochs come first;
the keys decide the rest.  The prefix sum is a radix selection: sizes are summed by source and
leading bits of the key, the bucket that crosses the budget is opened, and only the last small
bucket is sorted.  So no source passes through one task.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.llm.common import WORD, materialize

#: Buckets that a level of the radix selection has.
FAN = 1024
#: Sources that are broadcast with their cuts; more are joined by shuffle.
BROADCAST_SOURCES = 10_000
SYMBOLS = r"[!-/:-@\[-`{-~]"


def n_words(text: Column) -> Column:
    """Number of words by white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def quality(text: Column) -> Column:
    """Weight in (0, 1]: words against words and ASCII symbols; texts without words weigh 1."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)).cast("long"), F.lit(0).cast("long"))
    words = n_words(text)
    return F.when(words > 0, words / (words + symbols)).otherwise(F.lit(1.0))


def draw(doc_id: Column, weight: Column) -> Column:
    """Sort key in (0, 1): the exponential key x = -ln(u) / weight as x / (1 + x), which keeps its order.

    Keys stay apart for small weights too, where u^(1/weight) would run out of digits.  u comes from the MD5 of
    the id, so reruns agree.
    """
    u = (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    x = -F.ln(u) / weight
    return F.least(x / (F.lit(1.0) + x), F.lit(1.0 - 2.0**-53))


def targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """Adds ``target`` to rows (source, total): the sum of all totals, shared by weights 1, 2, 3,
    repeating over the sources by code point (null last), none above ``most`` times its total.

    Water-filling: sources whose cap is smallest against their weight are capped first.  This
    sorts the source table, one row per source, in one task.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    rows = sources.withColumn("weight", ((place - 1) % 3 + 1).cast("double")).withColumn("cap", (F.lit(most) * F.col("total")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("total").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / weights)
    # Once a source stays under its cap, so do all that follow, at its level.
    free = F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)
    return rows.withColumn("free", free["level"]).select(
        "source", "total", F.least("cap", F.coalesce(F.col("free") * F.col("weight"), F.col("cap"))).alias("target")
    )


def _crossing(rows: DataFrame, keys: list[str], bucket: str, budget: str) -> DataFrame:
    """The bucket of each key at which the running size first exceeds the budget, and the rest."""
    sums = rows.groupBy(*keys, bucket, budget).agg(F.sum("size").alias("size"))
    upto = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("size").over(upto))
    first = Window.partitionBy(*keys).orderBy(bucket)
    over = sums.where(F.col("upto") > F.col(budget)).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return over.select(*keys, bucket, (F.col(budget) - F.col("upto") + F.col("size")).alias("rest"))


def _join_sources(rows: DataFrame, sources: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    side = sources.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def plan_mix(slim: DataFrame, most: int = 3) -> DataFrame:
    """Rows (source, size, key, tie) to one row per source: source_size, target, epochs and the
    cut: documents with (key, tie) up to it are taken once more than ``epochs`` times.

    ``cut_key`` is null where none is.  Rows of one key and tie are taken together.  The document
    at the budget is taken if that brings the words nearer to the target.
    """
    sources = slim.groupBy("source").agg(F.sum("size").alias("total"))
    plan = targets(materialize(sources, "sources"), most)
    epochs = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(F.lit(0))
    plan = plan.withColumn("epochs", epochs.cast("long")).withColumn("budget", F.col("target") - F.col("epochs") * F.col("total"))
    plan = materialize(plan, "plan")
    few = plan.count() <= BROADCAST_SOURCES
    high = F.floor(F.col("key") * FAN).cast("int")
    low = F.floor((F.col("key") * FAN - F.floor(F.col("key") * FAN)) * FAN).cast("int")
    drawn = _join_sources(slim.withColumn("high", high).withColumn("low", low), plan.select("source", "budget"), few)
    outer = materialize(_crossing(drawn, ["source"], "high", "budget"), "outer")
    side = lambda x: F.broadcast(x) if few else x
    opened = slim.withColumn("high", high).withColumn("low", low)
    named = outer.select(F.col("source").alias("__source"), F.col("high").alias("__high"), "rest")
    opened = opened.join(side(named), opened["source"].eqNullSafe(named["__source"]) & (opened["high"] == named["__high"])).drop("__source", "__high")
    inner = materialize(_crossing(opened, ["source", "high"], "low", "rest").withColumnRenamed("rest", "left_over"), "inner")
    named = inner.select(F.col("source").alias("__source"), F.col("high").alias("__high"), F.col("low").alias("__low"), "left_over")
    same = opened["source"].eqNullSafe(named["__source"]) & (opened["high"] == named["__high"]) & (opened["low"] == named["__low"])
    leaf = opened.join(side(named), same).groupBy("source", "key", "tie", "left_over").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    taken = leaf.withColumn("before", before).where(F.col("before") + F.col("size") / 2 <= F.col("left_over"))
    cut = taken.groupBy("source").agg(F.max(F.struct("key", "tie")).alias("cut"))
    bound = inner.select("source", ((F.col("high") + F.col("low") / FAN) / FAN).alias("floor_key"))
    # Without a taken document in the leaf the cut lies just before the leaf; without a leaf all is taken.
    out = _join_sources(_join_sources(plan, bound, few, "left"), cut, few, "left")
    none = F.col("budget") <= 0
    return out.select(
        "source",
        F.col("total").alias("source_size"),
        "target",
        "epochs",
        F.when(~none, F.coalesce(F.col("cut.key"), F.col("floor_key"), F.lit(2.0))).alias("cut_key"),
        F.when(~none, F.col("cut.tie")).alias("cut_tie"),
    )


#: Names of the cut beside the columns of documents.
CUT = {"epochs": "__epochs", "cut_key": "__cut_key", "cut_tie": "__cut_tie"}


def _drawn(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    words = n_words(F.col(text))
    return docs.withColumns({
        "__size": words,
        "__key": draw(F.col(doc_id), quality(F.col(text))),
        "__tie": F.concat_ws("/", F.lpad(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), 20, "0"), F.lpad(F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("string"), 10, "0")),
        "__source": F.col(source),
    })


def _taken() -> Column:
    chosen = (F.col("__key") < F.col("__cut_key")) | ((F.col("__key") == F.col("__cut_key")) & (F.col("__tie") <= F.col("__cut_tie")))
    return F.col("__epochs") + F.when(chosen, 1).otherwise(0)


def mix_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: its id, size, source_size, target and taken (words taken in all).

    Null and empty texts have size 0.  Null sources are one source.  A source without words
    has target 0.  Reruns agree whatever the partitioning.
    """
    drawn = _drawn(docs.select(doc_id, text, source), doc_id, text, source)
    slim = materialize(drawn.select(F.col(doc_id).alias("id"), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__key").alias("key"), F.col("__tie").alias("tie")), "drawn")
    plan = materialize(plan_mix(slim), "cuts")
    rows = slim.withColumnsRenamed({"key": "__key", "tie": "__tie"})
    plan = plan.withColumnsRenamed(CUT)
    rows = _join_sources(rows, plan, plan.count() <= BROADCAST_SOURCES)
    return rows.select(F.col("id").alias(doc_id), "size", "source_size", "target", (F.col("size") * _taken()).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents as the mix takes them: rows left out, once, or repeated for each epoch."""
    drawn = _drawn(docs, doc_id, text, source)
    slim = drawn.select(F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__key").alias("key"), F.col("__tie").alias("tie"))
    plan = materialize(plan_mix(materialize(slim, "drawn")), "cuts")
    side = plan.select(F.col("source").alias("__name"), *[F.col(c).alias(n) for c, n in CUT.items()])
    side = F.broadcast(side) if plan.count() <= BROADCAST_SOURCES else side
    rows = drawn.join(side, F.col("__source").eqNullSafe(F.col("__name")))
    times = F.sequence(F.lit(1).cast("long"), F.col("__times"))
    copies = rows.withColumn("__times", _taken()).where("__times > 0").withColumn("__nth", F.explode(times))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])
