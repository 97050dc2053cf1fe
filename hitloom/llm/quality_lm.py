"""Quality classifier: perplexity under interpolated modified Kneser-Ney models of trusted text.

Word bigrams carry the model.  Those of all trusted text are counted and sharded by n-gram, as are
their continuation counts and back-off weights; each document's distinct n-grams meet these tables
by shuffle, so what is gathered grows with the input and only counts of counts are collected.
A word that was never seen falls to a byte trigram model of the same text, bounded by 2^24
trigrams, which spells it and goes to every task.

A trusted document is scored without its own counts, or it would find all its word pairs known.
The perplexities of the trusted documents of a language set its thresholds: one for the word
model, and one for the byte model alone, which knows bad spelling best.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import bounded_batches, materialize, shuffles_removed, utf8

#: Share of the trusted documents of a language that stays below its threshold.
QUANTILE = 0.995
#: Trusted ids that are broadcast, of eight bytes each; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
CHUNK = 1 << 22
#: Bytes of text whose n-grams are looked up together, and rows of n-grams in an Arrow batch.
BUCKET = 4_000_000
GRAM_ROWS = 50_000
#: N-grams that a task holds to leave out repeated ones.
ASKED_ROWS = 1_000_000
#: Bytes of trusted text whose word pairs make a shard.
SHARD = 2_000_000
#: Rounds in which texts of more than so many bytes are scored; each reads the table of texts anew.
ROUNDS = 7
ROUND_BYTES = 32_000_000
#: Buckets of a task, which has the byte model to unpack.
TASK_BUCKETS = 3
#: Byte that stands twice before each text.
START = 0


def trigrams(text: bytes) -> np.ndarray:
    """Each byte with the two before it, as one number."""
    b = np.concatenate(([START, START], np.frombuffer(text, dtype=np.uint8))).astype(np.int32)
    return (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]


def count_trigrams(texts: DataFrame, text: str) -> DataFrame:
    """(gram, n) over all texts: a task sums its own counts, the shuffle adds those of the tasks."""
    bounded_batches(texts.sparkSession)

    def run(batches):
        total: dict[int, int] = {}
        for batch in batches:
            kept = [t for t in utf8(batch.column(0)) if t]
            size, part = 0, []
            for t in kept:
                for at in range(0, len(t), CHUNK):
                    grams = trigrams(t[max(0, at - 2) : at + CHUNK])
                    part.append(grams if at == 0 else grams[2:])
                    size += len(part[-1])
                    if size > CHUNK:
                        _add(total, part)
                        size, part = 0, []
            _add(total, part)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    return texts.select(text).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _add(total: dict[int, int], part: list[np.ndarray]) -> None:
    if part:
        for gram, n in zip(*(x.tolist() for x in np.unique(np.concatenate(part), return_counts=True)), strict=True):
            total[gram] = total.get(gram, 0) + n


def discounts(k: list[int]) -> list[float]:
    """Discounts of n-grams seen once, twice and more often, from the numbers k of n-grams seen
    one to four times.  Where these are missing, in tiny or saturated tables, plain ones stand in."""
    y = k[0] / (k[0] + 2 * k[1]) if k[0] else 0.0
    found = [i - (i + 1) * y * k[i] / k[i - 1] if k[i - 1] and k[i] and y else 0.5 * i for i in (1, 2, 3)]
    return [min(max(d, 0.05), i - 0.05) for i, d in zip((1, 2, 3), found, strict=True)]


def _order(counts: DataFrame, context: str) -> DataFrame:
    """Adds to (context, last, n) the discounted share of each n-gram and the weight ``back`` that
    its context leaves to the shorter order: modified Kneser-Ney with three discounts."""
    seen = {r.n: r.k for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    d1, d2, d3 = discounts([seen.get(i, 0) for i in (1, 2, 3, 4)])
    cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    rows = counts.withColumn("cut", cut)
    totals = rows.groupBy(context).agg(F.sum("n").alias("total"), F.sum("cut").alias("cuts"))
    rows = rows.join(totals, context)
    return rows.select(context, "last", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"), (F.col("cuts") / F.col("total")).alias("back"))


class Model:
    """Bits of every byte trigram, from the columns context, last, own and back of the count joins."""

    def __init__(self, orders: list[tuple[np.ndarray, ...]]):
        self.orders = orders

    def table(self) -> np.ndarray:
        """Dense bits of all 2^24 trigrams, 64 MB: built by each task from the sparse rows."""
        prob = np.full(256, 1 / 256)
        for level, (context, last, own, back) in enumerate(self.orders):
            prob = np.ascontiguousarray(np.broadcast_to(prob, (256,) * level + (256,)), dtype=np.float32).reshape(256**level, 256)
            if len(context):
                weight = np.ones(256**level, dtype=np.float32)
                weight[context.astype(np.int64)] = back
                prob = prob * weight[:, None]
                prob[context.astype(np.int64), last.astype(np.int64)] += own.astype(np.float32)
            prob = prob.reshape((256,) * (level + 1))
        np.log2(prob, out=prob)
        return np.negative(prob, out=prob).reshape(-1)


def train(trusted: DataFrame, text: str = "text") -> Model:
    """The model of all trusted texts.  Without any text every byte costs eight bits."""
    counts = materialize(count_trigrams(trusted, text), "trigrams")
    high = counts.select(F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(255).alias("last"), "n")
    # Continuation counts: how many different bytes precede a pair, and how many pairs end in a byte.
    pairs = counts.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("pair")).agg(F.count("*").alias("n"))
    pairs = materialize(pairs, "pairs")
    middle = pairs.select(F.shiftright("pair", 8).alias("context"), F.col("pair").bitwiseAND(255).alias("last"), "n")
    low = pairs.groupBy(F.col("pair").bitwiseAND(255).alias("last")).agg(F.count("*").alias("n")).select(F.lit(0).alias("context"), "last", "n")
    # As arrays of 16 bytes a trigram: 256 MB at most, when all 2^24 occur.
    kinds = {"context": "int", "last": "int", "own": "float", "back": "float"}
    found = [_order(x, "context").select(*[F.col(c).cast(k) for c, k in kinds.items()]).toArrow() for x in (low, middle, high)]
    return Model([tuple(table.column(c).to_numpy() for c in kinds) for table in found])


def perplexity(docs: DataFrame, model: Model, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, n_bytes and perplexity (per byte) of every row; null and empty texts have a null one."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(*keep, F.col(text).alias("__text"))
    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("double").alias("perplexity")).schema

    def bits(text: bytes, table: np.ndarray) -> float:
        out = 0.0
        for at in range(0, len(text), CHUNK):
            grams = trigrams(text[max(0, at - 2) : at + CHUNK])
            out += float(table[grams if at == 0 else grams[2:]].sum(dtype=np.float64))
        return out

    def run(batches):
        table = None
        for batch in batches:
            table = model.table() if table is None else table
            texts = utf8(batch.column(batch.num_columns - 1))
            found = [2 ** (bits(t, table) / len(t)) if t else None for t in texts]
            arrays = [*batch.columns[:-1], pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(found, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return slim.mapInArrow(run, schema)


def words(text: bytes) -> np.ndarray:
    """Hashes of the words of a text, of which white space is no part."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in text.split()], dtype=np.uint64)


def _before(h: np.ndarray) -> np.ndarray:
    """The word before each; before the first stands nothing, as 0."""
    return np.concatenate((np.zeros(1, np.uint64), h[:-1])) if len(h) else h


def _mixed(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    x = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (h + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(h: np.ndarray) -> np.ndarray:
    """A key for each word with the one before it."""
    return _mixed(_before(h), h)


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of eight-byte numbers as compressed bytes.  The first should rise: of it the steps are kept."""
    steps = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T for c in (steps, *columns[1:])])
    return len(steps).to_bytes(8, "little") + pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def spread(data: bytes, *kinds: type) -> list[np.ndarray]:
    """The columns that ``squeeze`` has packed."""
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 8 * n * len(kinds), asbytes=True), np.uint8).reshape(len(kinds), 8, n)
    found = [np.ascontiguousarray(p.T).reshape(-1).view(k) for p, k in zip(planes, kinds, strict=True)]
    return [np.cumsum(found[0], dtype=kinds[0]), *found[1:]]


def _joined(blobs: list[bytes], *kinds: type) -> list[np.ndarray]:
    parts = [spread(b, *kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each key: shards are ranges of keys."""
    return (((key >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)).astype(np.int64)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    edges = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return list(zip(edges[:-1], edges[1:], strict=True)) if len(x) else []


def _shards(size: int) -> int:
    return 1 + size // SHARD


def _size(texts: DataFrame, text: str) -> int:
    return texts.agg(F.sum(F.octet_length(text))).first()[0] or 0


def packed_pairs(texts: DataFrame, text: str, shards: int) -> DataFrame:
    """(shard, data): before, word and n of the word pairs of all texts, one row for each shard of pairs."""
    bounded_batches(texts.sparkSession)

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        word, before = np.concatenate(held), np.concatenate([_before(h) for h in held])
        key, first, n = np.unique(_mixed(before, word), return_index=True, return_counts=True)
        word, before, shard = word[first], before[first], _shard(key, shards)
        order = np.lexsort((word, before, shard))
        word, before, n, shard = (x[order] for x in (word, before, n.astype(np.int64), shard))
        runs = _runs(shard)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard[a] for a, _ in runs], pa.int64()), pa.array([squeeze(before[a:b], word[a:b], n[a:b]) for a, b in runs], pa.binary())], names=["shard", "data"]
        )

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for t in utf8(batch.column(0)):
                if t and len(h := words(t)):
                    held.append(h)
                    size += len(h)
                    if size > ASKED_ROWS:
                        yield dealt(held)
                        held, size = [], 0
        if held:
            yield dealt(held)

    def summed(shard: int, blobs: list[bytes]) -> pa.RecordBatch:
        before, word, n = _joined(blobs, np.uint64, np.uint64, np.int64)
        order = np.lexsort((word, before))
        before, word, n = before[order], word[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (word[1:] != word[:-1]))))
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([squeeze(before[first], word[first], np.add.reduceat(n, first))], pa.binary())], names=["shard", "data"])

    def add(batches):
        at, blobs = None, []
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != at and blobs:
                    yield summed(at, blobs)
                    blobs = []
                at = shard
                blobs.append(data)
        if blobs:
            yield summed(at, blobs)

    parts = texts.select(text).mapInArrow(count, "shard long, data binary")
    return parts.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard").mapInArrow(add, "shard long, data binary")


def pair_rows(packed: DataFrame) -> DataFrame:
    """(key, before, word, n) of packed pairs."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                before, word, n = spread(data, np.uint64, np.uint64, np.int64)
                longs = [pa.array(x.view(np.int64)) for x in (_mixed(before, word), before, word, n)]
                yield pa.RecordBatch.from_arrays(longs, names=["key", "before", "word", "n"])

    return packed.select("data").mapInArrow(run, "key long, before long, word long, n long")


def count_pairs(texts: DataFrame, text: str) -> DataFrame:
    """(key, before, word, n) of the word pairs of all texts, sharded by pair."""
    return pair_rows(packed_pairs(texts, text, _shards(_size(texts, text))))


def _cut(n, d: list[float]):
    return F.when(n <= 0, 0.0).when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def _discounts(counts: DataFrame) -> list[float]:
    seen = {r.n: r.k for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    return discounts([seen.get(i, 0) for i in (1, 2, 3, 4)])


class WordModel:
    """Sharded ``stats`` (key, n, total, cuts) of the word pairs and words of trusted text, and the
    discounts and totals of both orders.  ``n`` of a word counts the words that precede it;
    ``total`` and ``cuts`` are those of the pairs that it begins."""

    def __init__(self, trusted: DataFrame, text: str):
        self.shards = _shards(_size(trusted, text))
        pairs = pair_rows(materialize(packed_pairs(trusted, text, self.shards), "word_pairs"))
        self.d2 = _discounts(pairs)
        contexts = pairs.groupBy(F.col("before").alias("key")).agg(F.sum("n").alias("total"), F.sum(_cut(F.col("n"), self.d2)).alias("cuts"))
        lasts = pairs.groupBy(F.col("word").alias("key")).agg(F.count("*").alias("n"))
        single = materialize(lasts.join(contexts, "key", "full").select("key", F.coalesce("n", F.lit(0)).alias("n"), "total", "cuts"), "words")
        self.d1 = _discounts(single.where("n > 0"))
        sums = single.agg(F.sum("n"), F.sum(_cut(F.col("n"), self.d1))).first()
        self.total, self.cuts = float(sums[0] or 0), float(sums[1] or 0)
        self.stats = pairs.select("key", "n", F.lit(None).cast("long").alias("total"), F.lit(None).cast("double").alias("cuts")).unionByName(single)


def _look(key: np.ndarray, table: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """Columns of a table, whose first one is sorted keys, at ``key``; 0 where it has none."""
    if not len(table[0]):
        return [np.zeros(len(key)) for _ in table[1:]]
    at = np.minimum(np.searchsorted(table[0], key), len(table[0]) - 1)
    hit = table[0][at] == key
    return [np.where(hit, c[at], 0.0) for c in table[1:]]


def word_bits(text: bytes, byte_bits: np.ndarray, table: tuple[np.ndarray, ...], own: bool, d1: list[float], d2: list[float], total: float, cuts: float) -> float:
    """Bits of a text, of whose bytes ``byte_bits`` are the bits in the byte model.

    ``table`` has keys, n, total and cuts.  With ``own`` the counts of the text itself are taken out.
    """
    h = words(text)
    if not len(h) or not total:
        return float(byte_bits.sum(dtype=np.float64))
    raw = np.frombuffer(text, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    spelt = np.add.reduceat(np.where(space, 0.0, byte_bits), starts, dtype=np.float64)
    d1, d2 = np.array([0.0, *d1]), np.array([0.0, *d2])
    cut = lambda n, d: d[np.minimum(n, 3).astype(int)]

    keys, first, back, c = np.unique(pair_keys(h), return_index=True, return_inverse=True, return_counts=True)
    kinds, place = np.unique(np.concatenate((np.zeros(1, np.uint64), h)), return_inverse=True)
    before, last = place[:-1][first], place[1:][first]
    n2 = _look(keys, table)[0]
    n1, sums, weights = _look(kinds, table)
    if own:
        left = np.maximum(n2 - c, 0)
        lost = (n2 > 0) & (left == 0)
        sums = sums - np.bincount(before, c, len(kinds))
        weights = weights - np.bincount(before, cut(n2, d2) - cut(left, d2), len(kinds))
        rest = np.maximum(n1 - np.bincount(last, lost, len(kinds)), 0)
        cuts -= float((cut(n1, d1) - cut(rest, d1)).sum())
        total -= float(lost.sum())
        n2, n1 = left, rest
    base = np.exp2(-np.minimum(spelt, 1000))
    p = base
    if total > 0.5:
        p = (np.maximum(n1 - cut(n1, d1), 0) / total)[place[1:]] + max(cuts, 0.0) / total * base
    known = sums > 0.5
    share = np.where(known, np.maximum(weights, 0) / np.maximum(sums, 1), 1.0)
    pair = np.where(known[before], (n2 - cut(n2, d2)) / np.maximum(sums, 1)[before], 0.0)
    p = pair[back] + share[place[:-1]] * p
    bits = np.where(p > 0, -np.log2(np.maximum(p, 1e-300)), spelt)
    return float(bits.sum() + byte_bits[space].sum(dtype=np.float64))


def packed_stats(stats: DataFrame, shards: int) -> DataFrame:
    """(shard, data): key, n, total and cuts of the rows of ``stats``, some rows for each shard."""

    def dealt(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        cols = [np.concatenate([h[i] for h in held]) for i in range(4)]
        order = np.argsort(cols[0])
        cols = [c[order] for c in cols]
        shard = _shard(cols[0], shards)
        runs = _runs(shard)
        return pa.RecordBatch.from_arrays([pa.array([shard[a] for a, _ in runs], pa.int64()), pa.array([squeeze(*[c[a:b] for c in cols]) for a, b in runs], pa.binary())], names=["shard", "data"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            cols = [c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append([cols[0].view(np.uint64), *cols[1:]])
            size += len(cols[0])
            if size > ASKED_ROWS:
                yield dealt(held)
                held, size = [], 0
        if held:
            yield dealt(held)

    return stats.select("key", "n", F.col("total").cast("long"), F.col("cuts").cast("double")).mapInArrow(run, "shard long, data binary")


#: What a row of the stats has, packed.
STATS = (np.uint64, np.int64, np.int64, np.float64)


def _requests(held: list[tuple[int, np.ndarray]], shards: int) -> pa.RecordBatch:
    """The different (bucket, key) of some documents, one row for each shard."""
    at, keys = np.repeat(np.array([a for a, _ in held], np.int64), [len(k) for _, k in held]), np.concatenate([k for _, k in held])
    shard = _shard(keys, shards)
    order = np.lexsort((keys, at, shard))
    at, keys, shard = at[order], keys[order], shard[order]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (keys[1:] != keys[:-1])))
    at, keys, shard = at[new], keys[new], shard[new]
    runs = _runs(shard)
    # Keys rise within a bucket only; the few steps down between buckets wrap.
    return pa.RecordBatch.from_arrays([pa.array([shard[a] for a, _ in runs], pa.int64()), pa.array([squeeze(keys[a:b], at[a:b]) for a, b in runs], pa.binary())], names=["shard", "data"])


def _found(asked: DataFrame, table: DataFrame, shards: int) -> DataFrame:
    """(bucket, data): of the requested n-grams of each bucket those that the table has, with their counts."""

    def answers(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        at, *cols = (np.concatenate([h[i] for h in held]) for i in range(5))
        order = np.lexsort((cols[0], at))
        order = order[np.concatenate(([True], (np.diff(at[order]) != 0) | (np.diff(cols[0][order]) != 0)))]
        at, cols = at[order], [c[order] for c in cols]
        runs = _runs(at)
        return pa.RecordBatch.from_arrays([pa.array([at[a] for a, _ in runs], pa.int64()), pa.array([squeeze(*[c[a:b] for c in cols]) for a, b in runs], pa.binary())], names=["__bucket", "data"])

    def run(batches):
        at, blobs, stats, held, size = None, [], None, [], 0
        for batch in batches:
            for shard, kind, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard != at:
                    at, blobs, stats = shard, [], None
                if kind == 0:
                    blobs.append(data)
                    continue
                if stats is None:
                    cols = _joined(blobs, *STATS)
                    order = np.argsort(cols[0])
                    stats, blobs = [c[order] for c in cols], []
                keys, bucket = spread(data, np.uint64, np.int64)
                if not len(stats[0]):
                    continue
                place = np.minimum(np.searchsorted(stats[0], keys), len(stats[0]) - 1)
                hit = stats[0][place] == keys
                held.append([bucket[hit], *[c[place[hit]] for c in stats]])
                size += int(hit.sum())
                if size > ASKED_ROWS:
                    yield answers(held)
                    held, size = [], 0
        if size:
            yield answers(held)

    both = table.select("shard", F.lit(0).alias("kind"), "data").unionByName(asked.select("shard", F.lit(1).alias("kind"), "data"))
    return both.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "kind").mapInArrow(run, "__bucket long, data binary")


def word_perplexity(docs: DataFrame, model: Model, bigrams: WordModel, text: str, keep: tuple[str, ...], own: str) -> DataFrame:
    """``keep``, n_bytes, perplexity and spelling (that of the byte model alone), both per byte, of
    every row; null and empty texts have null ones.  Rows that are true in column ``own`` are scored without their own counts.

    Rows are dealt into buckets by a hash.  The distinct n-grams of each document are joined to the
    sharded counts, and what is found goes to the bucket's task ahead of its texts.  Buckets take
    turns in ``ROUNDS`` rounds, as requests are larger than texts: each round's shuffles go when it ends.
    """
    spark = docs.sparkSession
    shards = bigrams.shards
    size = _size(docs, text)
    rounds = ROUNDS if size > ROUND_BYTES else 1
    buckets = 1 + size // BUCKET
    tasks = -(-buckets // (rounds * TASK_BUCKETS))
    dealt = docs.select(F.pmod(F.xxhash64(*keep, text), F.lit(buckets)).alias("__bucket"), *keep, F.col(own).alias("__own"), F.col(text).alias("__text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", GRAM_ROWS)
    table = materialize(packed_stats(bigrams.stats, shards), "word_table")
    bounded_batches(spark)

    def ask(batches):
        held, size = [], 0
        for batch in batches:
            bucket = batch.column(0).to_pylist()
            for at, t in zip(bucket, utf8(batch.column(1)), strict=True):
                h = words(t)
                keys = np.unique(np.concatenate((np.zeros(1, np.uint64), h, pair_keys(h))))
                held.append((at, keys))
                size += len(keys)
                if size > ASKED_ROWS:
                    yield _requests(held, shards)
                    held, size = [], 0
        if held:
            yield _requests(held, shards)

    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_bytes"), *[F.lit(None).cast("double").alias(c) for c in ("perplexity", "spelling")]).schema
    d1, d2, total, cuts = bigrams.d1, bigrams.d2, bigrams.total, bigrams.cuts

    def run(batches):
        dense, blobs, table, bucket = None, [], None, None
        for batch in batches:
            dense = model.table() if dense is None else dense
            at, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(at)], strict=True):
                piece = batch.slice(a, b - a)
                if at[a] != bucket:
                    bucket, blobs, table = at[a], [], None
                if kind[a] == 0:
                    blobs += piece.column(2).to_pylist()
                    continue
                if table is None:
                    cols = _joined(blobs, *STATS)
                    # Two tasks may have asked for one n-gram of a bucket.
                    key, first = np.unique(cols[0], return_index=True)
                    table, blobs = (key, *[c[first].astype(np.float64) for c in cols[1:]]), []
                own, texts = piece.column(piece.num_columns - 2).to_pylist(), utf8(piece.column(piece.num_columns - 1))
                scores = []
                for t, o in zip(texts, own, strict=True):
                    spelt = dense[trigrams(t)] if t else None
                    both = (word_bits(t, spelt, table, o, d1, d2, total, cuts), float(spelt.sum(dtype=np.float64))) if t else ()
                    scores.append([2 ** (x / len(t)) for x in both] or [None, None])
                arrays = [*piece.columns[3:-2], pa.array([len(t or b"") for t in texts], pa.int64()), *[pa.array([x[i] for x in scores], pa.float64()) for i in (0, 1)]]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def scored(turn: int) -> DataFrame:
        mine = dealt.where(F.col("__bucket") % rounds == turn)
        asked = mine.where(F.octet_length("__text") > 0).select("__bucket", "__text").mapInArrow(ask, "shard long, data binary")
        nulls = [F.lit(None).cast(dealt.schema[n].dataType).alias(n) for n in (*keep, "__own", "__text")]
        found = _found(asked, table, shards).select("__bucket", F.lit(0).alias("__kind"), "data", *nulls)
        both = found.unionByName(mine.select("__bucket", F.lit(1).alias("__kind"), F.lit(None).cast("binary").alias("data"), *keep, "__own", "__text"))
        place = F.pmod(F.floor(F.col("__bucket") / rounds), F.lit(tasks)).cast("int")
        rows = both.repartitionById(tasks, place).sortWithinPartitions("__bucket", "__kind").mapInArrow(run, schema)
        return materialize(rows, "perplexities")

    with shuffles_removed(spark):
        return reduce(DataFrame.unionByName, [scored(turn) for turn in range(rounds)])


def classify(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """One row per document: its id, language, n_bytes, perplexity, threshold and keep.

    ``trusted_ids`` has one column of ids.  The threshold is the ``quantile`` of the perplexities
    of the trusted documents of the language (null is a language of its own), or of all trusted
    ones where the language has none; with no trusted text it is null and everything is kept.
    A document is kept if its perplexity, and that of its bytes alone, pass their thresholds.
    Texts without bytes have no perplexity and are not kept.
    """
    ids = trusted_ids.toDF("__id").dropna().distinct()
    ids = materialize(ids, "trusted")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    flagged = docs.select(F.col(doc_id), F.col(lang), F.col(text).alias("__body")).join(side, F.col(doc_id) == F.col("__id"), "left")
    flagged = flagged.withColumn("trusted", F.col("__id").isNotNull()).drop("__id")
    model = train(flagged.where("trusted"), "__body")
    with shuffles_removed(docs.sparkSession):
        bigrams = WordModel(flagged.where("trusted"), "__body")
    scored = word_perplexity(flagged, model, bigrams, "__body", (doc_id, lang, "trusted"), "trusted")
    sure = scored.where("trusted AND perplexity IS NOT NULL")
    at = [F.percentile_approx(c, F.lit(quantile), F.lit(10_000)) for c in ("perplexity", "spelling")]
    by_lang = sure.groupBy(F.col(lang).alias("__lang")).agg(at[0].alias("__own"), at[1].alias("__own_spelling"))
    overall = sure.agg(*at).first()
    rows = scored.join(by_lang, F.col(lang).eqNullSafe(F.col("__lang")), "left")
    rows = rows.withColumn("threshold", F.coalesce("__own", F.lit(overall[0]).cast("double")))
    spelling = F.coalesce("__own_spelling", F.lit(overall[1]).cast("double"))
    within = F.coalesce((F.col("perplexity") <= F.col("threshold")) & (F.col("spelling") <= spelling), F.lit(True))
    keep = F.col("perplexity").isNotNull() & within
    return rows.select(doc_id, lang, "n_bytes", "perplexity", "threshold", keep.alias("keep"))
