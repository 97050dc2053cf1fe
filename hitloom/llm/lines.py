"""Removal of lines that many documents share, through a sharded minimal perfect hash.

The 128-bit hashes of lines are counted by documents.  Those that enough documents have are dealt
into shards of bounded size; each shard gets a minimal perfect hash function, which leads a hash to its own
place among the shard's, and two arrays in that order: fingerprints, which tell other lines apart, and
counts.  Documents then probe these arrays; lines are never joined with lines.

The function is a chain of bit arrays: a hash that alone falls on a bit of the first sets it, those that
collide go on to the next, smaller one.  The place of a hash is the number of set bits before its own.

An index of up to ``BROADCAST_BYTES`` goes to every task.  A larger one stays dealt: each document sends
its hashes packed, one row for each shard they fall in, and shards that very many documents ask are
copied to several tasks.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import bounded_batches, materialize, utf8

#: Hashes of a shard on average.
SHARD = 1 << 16
#: Bits of the first array for each hash, and the levels after which the last hashes are listed.
GAMMA, LEVELS = 2.0, 24
#: Bytes of an index that every task may hold.
BROADCAST_BYTES = 64 << 20
#: Bytes of an entry of the index: fingerprint, count, and bits with their ranks.
ENTRY = 14
#: Askings of a shard that one task serves, when the index is dealt.
ASKED = 1 << 22
INDEX = "shard int, levels array<binary>, rest binary, fingerprints binary, counts binary"


def line_hashes(lines: list[bytes]) -> list[bytes]:
    """16 bytes for each line: XXH3 of its key, the line without white space (space, tab to carriage return)
    at its ends and with A-Z in lower case; empty for an empty key."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    return [digest(key) if key else b"" for key in (line.strip(b" \t\n\v\f\r").lower() for line in lines)]


def as_words(hashes: list[bytes] | bytes) -> np.ndarray:
    """(n, 2) words of 64 bits."""
    return np.frombuffer(b"".join(hashes) if isinstance(hashes, list) else hashes, dtype=">u8").reshape(-1, 2).astype(np.uint64)


def shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    return (words[:, 0] % np.uint64(shards)).astype(np.int64)


def _spot(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each hash in the bit array of a level."""
    x = words[:, 0] ^ (words[:, 1] + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash function over distinct hashes, built level by level."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, before = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(before + np.cumsum(ones) - ones)
            before += int(ones.sum())
        self.listed = {tuple(w): before + i for i, w in enumerate(rest.tolist())}

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        levels = []
        while len(words) and len(levels) < LEVELS:
            n = -(-int(GAMMA * len(words)) // 64)
            spots = _spot(words, len(levels), 64 * n)
            alone = np.bincount(spots, minlength=64 * n)[spots] == 1
            bits = np.zeros(64 * n, bool)
            bits[spots[alone]] = True
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            words = words[~alone]
        return cls(levels, words)

    def places(self, words: np.ndarray) -> np.ndarray:
        """The place of each member of the set; of any other hash some place, or -1."""
        out = np.full(len(words), -1, np.int64)
        open_ = np.arange(len(words))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(open_):
                break
            spots = _spot(words[open_], level, 64 * len(bits))
            word, bit = bits[spots >> 6], (spots & 63).astype(np.uint64)
            on = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[on]] = (ranks[spots >> 6] + below)[on]
            open_ = open_[~on]
        if self.listed:
            for i in open_:
                out[i] = self.listed.get(tuple(words[i].tolist()), -1)
        return out


class Shard:
    """One shard of the index: the function, and fingerprints and counts in its order."""

    def __init__(self, levels: list[bytes], rest: bytes, fingerprints: bytes, counts: bytes):
        self.hash = PerfectHash([np.frombuffer(b, "<u8") for b in levels], as_words(rest))
        self.fingerprints, self.numbers = np.frombuffer(fingerprints, "<u8"), np.frombuffer(counts, "<u4")

    @staticmethod
    def pack(words: np.ndarray, numbers: np.ndarray) -> tuple[list[bytes], bytes, bytes, bytes]:
        made = PerfectHash.build(words)
        place = made.places(words)
        prints, counts = np.empty(len(words), "<u8"), np.empty(len(words), "<u4")
        prints[place], counts[place] = words[:, 1], np.minimum(numbers, (1 << 32) - 1)
        return [b.tobytes() for b in made.levels], made.rest.astype(">u8").tobytes(), prints.tobytes(), counts.tobytes()

    def counts(self, words: np.ndarray) -> np.ndarray:
        """In how many documents each line stands; 0 for lines that the index lacks."""
        place = self.hash.places(words)
        if not len(self.fingerprints):
            return np.zeros(len(words), np.int64)
        return np.where((place >= 0) & (self.fingerprints[place] == words[:, 1]), self.numbers[place], 0).astype(np.int64)


def _documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, n): how many texts of each batch have a line."""
    for batch in batches:
        found: Counter = Counter()
        for text in utf8(batch.column(0)):
            found.update(set(line_hashes(text.split(b"\n"))) if text else ())
        found.pop(b"", None)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["hash", "n"])


def line_index(docs: DataFrame, least: int = 1, text: str = "text", shard: int = SHARD) -> tuple[DataFrame, int, int]:
    """The index of all lines that ``least`` documents or more have, how many lines these are, and its shards.

    It is stored in the shared folder, a row of ``INDEX`` for each shard.  A document is a row, whatever its
    id; counts beyond 2^32 stay there.  Lines whose key is empty are left out.
    """
    bounded_batches(docs.sparkSession)
    parts = docs.select(text).mapInArrow(_documents_of, "hash binary, n bigint")
    counted = materialize(parts.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "lines")
    total = counted.count()
    shards = max(1, -(-total // shard))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = as_words(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(words, shards), pa.int32()), *batch.columns], names=["shard", "hash", "n"])

    def packed(table: pa.Table) -> pa.Table:
        levels, rest, prints, counts = Shard.pack(as_words(table.column("hash").to_pylist()), table.column("n").to_numpy())
        columns = [[table.column("shard")[0].as_py()], [levels], [rest], [prints], [counts]]
        kinds = (pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split(" ")[0] for f in INDEX.split(", ")])

    rows = counted.mapInArrow(dealt, "shard int, hash binary, n bigint")
    return materialize(rows.groupBy("shard").applyInArrow(packed, INDEX), "line-index"), total, shards


def _here(batches: Iterator[pa.RecordBatch], index, shards: int, least: int) -> Iterator[pa.RecordBatch]:
    """Drops lines with the whole index at hand."""
    held = {n: Shard(*row) for n, row in index.value.items()}
    for batch in batches:
        texts = [t or b"" for t in utf8(batch.column(1))]
        split = [t.split(b"\n") for t in texts]
        hashes = [h for lines in split for h in line_hashes(lines)]
        full = np.array([len(h) > 0 for h in hashes], bool)
        words = as_words([h for h in hashes if h])
        drop, numbers, shard = np.zeros(len(hashes), bool), np.zeros(len(words), np.int64), shard_of(words, shards)
        for n in np.unique(shard):
            mine = shard == n
            if n in held:
                numbers[mine] = held[n].counts(words[mine])
        drop[full] = numbers >= least
        ends = np.cumsum([len(x) for x in split])
        parts = np.split(drop, ends[:-1])
        kept = [b"\n".join(x for x, gone in zip(lines, part) if not gone) if part.any() else t for t, lines, part in zip(texts, split, parts)]
        yield _result(batch.column(0), [len(x) for x in split], [int(p.sum()) for p in parts], kept)


def _result(key: pa.Array, n_lines: list[int], n_dropped: list[int], kept: list[bytes]) -> pa.RecordBatch:
    texts = pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())
    return pa.RecordBatch.from_arrays([key, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), texts], names=["key", "n_lines", "n_dropped", "kept"])


def _askings(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """(text_hash, shard, hashes): the different lines of each different text of a batch, packed by shard."""
    for batch in batches:
        rows: list[tuple[bytes, int, bytes]] = []
        for text in {t for t in utf8(batch.column(0)) if t}:
            mine = sorted({h for h in line_hashes(text.split(b"\n")) if h})
            words = as_words(mine)
            shard = shard_of(words, shards)
            for n in np.unique(shard):
                rows.append((hashlib.sha256(text).digest(), int(n), b"".join(h for h, s in zip(mine, shard) if s == n)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.binary(), pa.int32(), pa.binary()))], names=["text_hash", "shard", "hashes"])


def _answers(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(text_hash, hit) of the lines to drop.  Rows come by shard, the shard itself before those that ask it."""
    held, number = None, None
    for batch in batches:
        rows: list[tuple[bytes, bytes]] = []
        for row in batch.to_pylist():
            if row["text_hash"] is None:
                held, number = Shard(*(row[c] for c in ("levels", "rest", "fingerprints", "counts"))), row["shard"]
            elif row["shard"] == number:
                counts = held.counts(as_words(row["hashes"]))
                hit = b"".join(row["hashes"][16 * i : 16 * i + 16] for i in np.flatnonzero(counts >= least))
                if hit:
                    rows.append((row["text_hash"], hit))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["text_hash", "hit"])


def _there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops the lines that the answers name."""
    for batch in batches:
        texts = [t or b"" for t in utf8(batch.column(1))]
        n_lines, n_dropped, kept = [], [], []
        for text, hits in zip(texts, batch.column(2).to_pylist()):
            lines = text.split(b"\n")
            gone = {h[i : i + 16] for h in hits or [] for i in range(0, len(h), 16)}
            stay = [x for x, h in zip(lines, line_hashes(lines)) if h not in gone] if gone else lines
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay))
        yield _result(batch.column(0), n_lines, n_dropped, kept)


def drop_frequent_lines(docs: DataFrame, least: int = 10, doc_id: str = "doc_id", text: str = "text", at_hand: int = BROADCAST_BYTES, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): each text without the lines that ``least`` documents or more have.

    Texts are split at ``\\n``; a null or empty one has one empty line, which stays.  A document counts once
    for a line, and every row is a document, whatever its id.  Lines are compared by 128-bit hashes of
    their keys, as bytes; in what is kept, each ill-formed stretch is one U+FFFD.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    index, total, shards = line_index(docs, least, text, shard)
    kind = docs.schema[doc_id].dataType.simpleString()
    out = f"key {kind}, n_lines bigint, n_dropped bigint, kept string"
    rows = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text"))
    if total * ENTRY <= at_hand:
        parts = {r.pop("shard"): tuple(r.values()) for r in index.toArrow().to_pylist()}
        named = spark.sparkContext.broadcast(parts)
        found = rows.mapInArrow(lambda batches: _here(batches, named, shards, least), out)
    else:
        asked = rows.select("text").mapInArrow(lambda batches: _askings(batches, shards), "text_hash binary, shard int, hashes binary")
        asked = materialize(asked, "askings")
        copies = asked.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("hashes")) / (16 * ASKED)).cast("int").alias("copies"))
        part = lambda n: F.pmod(F.xxhash64("text_hash"), n).cast("int")
        mine = asked.join(copies, "shard").withColumn("copy", part(F.col("copies"))).drop("copies")
        stored = index.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        both = stored.unionByName(mine, allowMissingColumns=True).repartition("shard", "copy")
        both = both.sortWithinPartitions("shard", "copy", F.col("text_hash").asc_nulls_first())
        hits = both.mapInArrow(lambda batches: _answers(batches, least), "text_hash binary, hit binary")
        hits = hits.groupBy("text_hash").agg(F.collect_set("hit").alias("hits"))
        named_rows = rows.withColumn("text_hash", F.unhex(F.sha2("text", 256)))
        found = named_rows.join(hits, "text_hash", "left").select("key", "text", "hits").mapInArrow(_there, out)
    return found.withColumnRenamed("key", doc_id)
