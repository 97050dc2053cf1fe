"""Sharding through fixed virtual slots and a stored, versioned map from slots to shards.

Records are hashed into thousands of slots, bytes are summed per slot, and the map sends
slots to shards so that bytes are near equal.  Rebalancing edits the map: it moves as few
slots as it can and stores the result as the next version; records never change slots.

Records are hashed by their text alone, so equal texts, a group, share a slot and a shard at every size.
Bytes are as near equal as whole groups allow: a group of more bytes than a shard's share makes its
shard larger than others.
"""

from __future__ import annotations

import heapq
import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitloom.llm.common import materialize

SLOTS = 4096
MAP_SCHEMA = "slot int, shard int"
#: Share of the mean by which shards may differ before a stored map is edited.
WITHIN = 0.002


def slot_of(*columns: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record: fixed for good by its columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def balanced(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """Shard of each slot: the largest slot goes to the least loaded shard, again and again."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, 0), shard))
    return out


def rebalanced(current: list[int], sizes: dict[int, int], shards: int, within: float = 0.02) -> list[int]:
    """An edit of the map for ``shards`` shards and these sizes, by single moves.

    Slots of shards that are gone move first; then slots move from the fullest to the emptiest
    shard while that narrows their gap and some shard is more than ``within`` off the mean.
    """
    out, load = list(current), [0] * shards
    for slot, shard in enumerate(out):
        if shard < shards:
            load[shard] += sizes.get(slot, 0)
    for slot in sorted((s for s, shard in enumerate(out) if shard >= shards), key=lambda s: (-sizes.get(s, 0), s)):
        out[slot] = min(range(shards), key=lambda s: (load[s], s))
        load[out[slot]] += sizes.get(slot, 0)
    mean = sum(load) / shards
    while True:
        full, empty = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        if max(load[full] - mean, mean - load[empty]) <= within * mean:
            return out
        fits = [s for s, shard in enumerate(out) if shard == full and 0 < sizes.get(s, 0) < gap]
        if not fits:
            return out
        slot = min(fits, key=lambda s: (abs(gap / 2 - sizes[s]), s))
        out[slot] = empty
        load[full] -= sizes[slot]
        load[empty] += sizes[slot]


def save_map(spark: SparkSession, path: str, version: int, shards: list[int]) -> None:
    """Stores the map as one version below ``path``; a version once written is never changed."""
    rows = spark.createDataFrame(list(enumerate(shards)), MAP_SCHEMA)
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version:06d}")


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    rows = spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version:06d}").orderBy("slot").collect()
    return [r.shard for r in rows]


def latest_version(spark: SparkSession, path: str) -> int:
    """The highest stored version whose writing was finished; 0 where there is none."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done) or []
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=0)


def current_map(spark: SparkSession, path: str, sizes: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """The map to place records by: the latest stored version, edited where these sizes or the
    number of shards ask for it; an edited or first map is stored as the next version.  Where another run
    has just stored that version, its map is the one to edit."""
    for _ in range(10):
        version = latest_version(spark, path)
        before = load_map(spark, path, version) if version else None
        if before is not None and len(before) != slots:
            raise ValueError(f"the map at {path} has {len(before)} slots instead of {slots}; slots are fixed for good")
        now = rebalanced(before if before is not None else balanced(sizes, shards, slots), sizes, shards, WITHIN)
        if now == before:
            return now
        try:
            save_map(spark, path, version + 1, now)
            return now
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            time.sleep(1)
    raise RuntimeError(f"other runs keep changing the map at {path}")


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot; as many rows as there are slots reach the driver, no more."""
    sums = rows.groupBy("vslot").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    return {r.vslot: (r["size"], r.n) for r in sums.collect()}


def shard_rows(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard, vslot.

    Law ``bytes``: the sums of ``size`` (UTF-8 bytes plus one; null texts have none) are near
    equal, as far as whole groups allow: rows of equal text share a virtual slot, and so a shard.
    ``slot`` numbers the rows of a shard without gaps from 0, in the order of virtual slot, part, id and text;
    a virtual slot of many rows is numbered in parts, dealt by the hash of the id, so that no task numbers a large
    group.  Null texts have crc 0 and are a group; null ids are hashed like any other; an empty table gives no rows.
    With ``map_path`` the map stored there places the records: its latest version is loaded and
    edited, and what was edited is stored as the next version.  The path names the table: maps are never shared.
    """
    slim = docs.select(
        F.col(doc_id).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        slot_of(F.xxhash64(text), slots=slots).alias("vslot"),
    )
    spark, slim = docs.sparkSession, materialize(slim, "digests")
    sizes = slot_sizes(slim)
    by_slot = {s: x[0] for s, x in sizes.items()}
    shard_map = current_map(spark, map_path, by_slot, shards, slots) if map_path else rebalanced(balanced(by_slot, shards, slots), by_slot, shards, WITHIN)
    # As many rows in a part as in a slot on average: there are at most twice as many parts as slots.
    rows_of_part = -(-sum(n for _, n in sizes.values()) // slots)
    parts = spark.createDataFrame([(s, -(-n // rows_of_part)) for s, (_, n) in sizes.items()], "vslot int, parts int")
    slim = slim.join(F.broadcast(parts), "vslot").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    counts = {(r.vslot, r.part): r.n for r in slim.groupBy("vslot", "part").agg(F.count("*").alias("n")).collect()}
    base, table = [0] * shards, []
    for slot, part in sorted(counts):
        shard = shard_map[slot]
        table.append((slot, part, shard, base[shard]))
        base[shard] += counts[slot, part]
    named = spark.createDataFrame(table, "vslot int, part int, shard int, base long")
    nth = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("id", "text_crc32", "size"))
    out = slim.withColumn("nth", nth).join(F.broadcast(named), ["vslot", "part"])
    return out.select(
        F.col("id").alias(doc_id), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )
