"""Countries of addresses: range joins by equal keys, over distinct addresses only.

IPv4 ranges may overlap, and the narrowest counts.  A sweep cuts them into disjoint pieces once, and each
piece into blocks of addresses that share a prefix; an address then has one key for each length of
prefix that there is, and at most one of these is a block, however many ranges crowd around it.

An IPv6 range has one key, the digits that its ends share, and an address has a key for each length of these.
A range of a key ends beyond another next digit than it starts with, so at most 15 ranges that do not
overlap have the same key, wherever addresses crowd.  A plain range condition would compare every
address with every range.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.functions.network import ip6_hex

UNKNOWN = "??"
IP4_BITS, TOP_BITS = 32, 8
IP6_DIGITS = 32


def _swept(table: pa.Table) -> pa.Table:
    """Disjoint pieces of the ranges of one first byte, neighbours of one country joined."""
    ranges = sorted(zip(*(table.column(c).to_pylist() for c in ("start", "end", "width", "first", "cc"))), key=lambda r: r[0])
    bounds = sorted({r[0] for r in ranges} | {r[1] + 1 for r in ranges})
    open_: list[tuple] = []
    pieces: list[list] = []
    nth = 0
    for low, high in zip(bounds, bounds[1:]):
        while nth < len(ranges) and ranges[nth][0] <= low:
            _, end, width, first, cc = ranges[nth]
            heapq.heappush(open_, (width, first, cc is not None, cc or "", end))
            nth += 1
        while open_ and open_[0][4] < low:
            heapq.heappop(open_)
        if open_:
            cc = open_[0][3] if open_[0][2] else None
            if pieces and pieces[-1][1] == low - 1 and pieces[-1][2] == cc:
                pieces[-1][1] = high - 1
            else:
                pieces.append([low, high - 1, cc])
    return pa.table([pa.array([p[i] for p in pieces], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["start", "end", "cc"])


def disjoint_ranges(ranges: DataFrame) -> DataFrame:
    """(start, end, cc): pieces of which no two overlap; where ranges do, the narrowest counts, then
    the one that starts first, then the first country.  Swept by the first byte of the address."""
    most = (1 << IP4_BITS) - 1
    rows = ranges.where(F.col("start") <= F.col("end")).select("start", "end", "cc").distinct()
    rows = rows.select(
        F.greatest("start", F.lit(0)).alias("low"), F.least("end", F.lit(most)).alias("high"), (F.col("end") - F.col("start")).alias("width"), F.col("start").alias("first"), "cc"
    ).where("low <= high")
    size = 1 << (IP4_BITS - TOP_BITS)
    rows = rows.withColumn("top", F.explode(F.sequence(F.floor(F.col("low") / size), F.floor(F.col("high") / size))))
    clipped = rows.select("top", F.greatest("low", F.col("top") * size).alias("start"), F.least("high", F.col("top") * size + size - 1).alias("end"), "width", "first", "cc")
    return clipped.groupBy("top").applyInArrow(_swept, "start bigint, end bigint, cc string")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bits, prefix, cc): the largest aligned blocks that make up each piece."""
    for batch in batches:
        rows = []
        for low, end, cc in zip(*(c.to_pylist() for c in batch.columns)):
            while low <= end:
                size = min(low & -low or 1 << IP4_BITS, 1 << ((end - low + 1).bit_length() - 1))
                bits = IP4_BITS - size.bit_length() + 1
                rows.append((bits, low >> (IP4_BITS - bits), cc))
                low += size
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string()))], names=["bits", "prefix", "cc"])


def ip_country(hits: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ipint, cc) of the distinct IPv4 numbers; of overlapping ranges the narrowest counts."""
    blocks = disjoint_ranges(ranges).mapInArrow(_blocks, "bits int, prefix bigint, cc string")
    lengths = sorted(r.bits for r in blocks.select("bits").distinct().collect())  # 33 at most
    keys = F.array(*[F.struct(F.lit(n).alias("bits"), F.shiftright("ipint", IP4_BITS - n).alias("prefix")) for n in lengths]) if lengths else F.lit(None).cast("array<struct<bits:int,prefix:bigint>>")
    addresses = hits.select(F.col("ipint").cast("bigint").alias("ipint")).where(F.col("ipint").between(0, (1 << IP4_BITS) - 1)).distinct()
    return addresses.withColumn("key", F.explode(keys)).select("ipint", "key.*").join(blocks, ["bits", "prefix"]).select("ipint", "cc")


def ip6_country(hits: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ip, cc) of the distinct IPv6 texts; of nested ranges the one that starts last counts."""
    shared = F.filter(F.sequence(F.lit(1), F.lit(IP6_DIGITS)), lambda n: F.substring("start_hex", 1, n) == F.substring("end_hex", 1, n))
    dealt = ranges.where(F.col("start_hex") <= F.col("end_hex")).select("start_hex", "end_hex", "cc", F.size(shared).alias("digits"))
    lengths = sorted(r.digits for r in dealt.select("digits").distinct().collect())  # 33 at most
    dealt = dealt.withColumn("key", F.substring("start_hex", F.lit(1), F.col("digits")))
    addresses = hits.select("ip").where(F.col("ip").contains(":")).distinct().withColumn("hex", ip6_hex(F.col("ip"))).where("hex IS NOT NULL")
    keys = F.array(*[F.substring("hex", 1, n) for n in lengths]) if lengths else F.lit(None).cast("array<string>")
    met = addresses.withColumn("key", F.explode(keys)).join(dealt, "key").where(F.col("hex").between(F.col("start_hex"), F.col("end_hex")))
    return met.groupBy("ip").agg(F.max_by("cc", F.struct("start_hex", "cc")).alias("cc"))


def with_country(visits: DataFrame, v4: DataFrame | None = None, v6: DataFrame | None = None) -> DataFrame:
    """Adds ``country``: that of the IPv4 number, else of the IPv6 address, else ``??``."""
    found = []
    if v4 is not None:
        visits = visits.join(v4.withColumnRenamed("cc", "cc4"), "ipint", "left")
        found.append("cc4")
    if v6 is not None:
        visits = visits.join(v6.withColumnRenamed("cc", "cc6"), "ip", "left")
        found.append("cc6")
    return visits.withColumn("country", F.coalesce(*found, F.lit(UNKNOWN))).drop(*found)
