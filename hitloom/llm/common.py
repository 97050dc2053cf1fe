"""What the corpus operators share: intermediate tables, Arrow batches, components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold, so that long texts cannot pile up in a worker.
BATCH_ROWS = 1000
BATCH_BYTES = "16m"

#: Words of the contracts that count words by white space, as Java and RE2 patterns.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a local folder serves, but only if Spark itself
    runs in this one process: on a cluster executors could not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts lineage in a way that survives lost executors: the files belong to no
    executor, and a lost task of the writing job is simply run again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hitloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries begun within remove their shuffle files as soon as they end, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def utf8(column: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def readable(text: bytes | None) -> str:
    """A text as characters: null is empty, and each ill-formed stretch is one U+FFFD, as
    ``make_valid_utf8`` has it.  Operators that read characters all read texts like this."""
    return text.decode("utf-8", "replace") if text else ""


def bucket(column: Column, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``: the folds of the labelled queries."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def components(links: DataFrame) -> DataFrame:
    """Connected components of the links (a, b), both long: one row (node, root) for each
    node but the roots; the root is the smallest node of the component.

    Alternates large-star and small-star passes until nothing changes, so the number of
    passes follows the logarithm of the longest chain.  Nothing is collected.  A hub with
    very many links is safe: its minimum is pre-aggregated, and the minima are written out
    so that the join back is one that adaptive execution can split.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    edges = materialize(links.select(hi.alias("hi"), lo.alias("lo")).where("hi <> lo").distinct(), "edges")
    seen = _digest(edges)
    while seen[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
        large = materialize(large.distinct(), "large")
        low = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "low")
        near = large.join(low, "hi")
        small = near.select("hi", F.col("m").alias("lo")).unionByName(
            near.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        )
        edges = materialize(small.distinct(), "edges")
        seen, before = _digest(edges), seen
        if seen == before:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _digest(edges: DataFrame) -> tuple[int, int | None]:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
