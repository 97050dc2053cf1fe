"""SimHash near-duplicates: 64-bit fingerprints linked through sharded BK-trees.

A fingerprint pair within three bits agrees on at least two of five bit blocks.  So every
distinct fingerprint goes to ten shards, one for each pair of blocks and its bits, and any
two that may link meet in one shard.  A shard is held as a BK-tree: children are keyed by
their Hamming distance to the parent, and a search follows only the edges within the radius
of its own distance.  The trees together are as large as the corpus, so none is broadcast;
the same shuffle brings the searches to the tree.

A shard gives back a spanning forest of its links rather than all pairs, and components of
the forest are components of the links.  A shard with more than ``CELL`` fingerprints is
dealt into tiles, and each pair of tiles is searched on its own: bounded memory, no link lost.

``dedup`` asks for more than three bits tell: texts whose five-word shingles agree to 0.8 or more.  Such
texts differ in ten bits of 64 on average, and no blocks of bits bring them together.  So there
the shards are buckets of MinHash bands, their BK-trees are searched with a radius of 20 bits, and
each link is confirmed by the exact similarity of the shingles before it joins two groups.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import bounded_batches, components, materialize, utf8

RADIUS = 3
SEED = 42
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Distinct fingerprints that one tile of a crowded shard holds.
CELL = 20_000
#: Words of a shingle and similarity of the near copies that ``dedup`` removes, and the bits by which
#: their fingerprints may differ: at that similarity 9.7 on average, with a deviation of 2.9.
COPY_WORDS, COPY_SIMILARITY, COPY_RADIUS = 5, 0.8, 20
#: MinHash bands and values of a band: at the similarity 0.8 a pair shares one with probability 0.985, at 0.9 nearly always.
BANDS, BAND = 8, 4
#: Bytes of shingle hashes that one cell of a bucket holds.
CELL_BYTES = 32 << 20
#: Rows whose keys are broadcast to be left out; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def shingles(text: bytes | None, size: int = 3) -> np.ndarray:
    """XXH64 of the shingles of a UTF-8 text, repeats included; fewer words are one shingle, none give none."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return np.zeros(0, dtype=">u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)]
    return np.array(hashes, dtype=">u8")


def fingerprint(text: bytes | None) -> int:
    """SimHash of a UTF-8 text: majority bits of the XXH64 of its three-word shingles."""
    return majority(shingles(text))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 without any."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65_536):
        counts += np.unpackbits(h[i : i + 65_536].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, and ``fp``: its fingerprint as a signed long.

    Null and empty texts have fingerprint zero.  Whole texts are read, of any length.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(*keep, F.col(text).alias("__text"))
    schema = docs.select(*keep, F.lit(0).cast("long").alias("fp")).schema

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in utf8(batch.column(batch.num_columns - 1))], dtype=np.uint64)
            columns = [*batch.columns[:-1], pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "fp"])

    return slim.mapInArrow(run, schema)


class BKTree:
    """BK-tree over distinct fingerprints, searched by many queries at once."""

    def __init__(self, members: np.ndarray):
        self.children: dict[int, BKTree] = {}
        todo = [(self, members)]
        while todo:
            node, own = todo.pop()
            node.root, rest = own[0], own[1:]
            gaps = np.bitwise_count(rest ^ node.root)
            for edge in np.unique(gaps).tolist():
                node.children[edge] = child = BKTree.__new__(BKTree)
                child.children = {}
                todo.append((child, rest[gaps == edge]))

    def links(self, queries: np.ndarray, radius: int = RADIUS):
        """Yields (member, its linked queries) for every node that some query reaches."""
        todo = [(self, queries)]
        while todo:
            node, queries = todo.pop()
            gaps = np.bitwise_count(queries ^ node.root).astype(np.int16)
            if (near := gaps <= radius).any():
                yield node.root, queries[near]
            for edge, child in node.children.items():
                if (open_ := np.abs(gaps - edge) <= radius).any():
                    todo.append((child, queries[open_]))


def _forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the members."""
    parent = {x: x for x in members.tolist()}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for member, near in BKTree(members).links(members, radius):
        top = find(int(member))
        for x in near.tolist():
            if (other := find(x)) != top:
                parent[other] = top
                out.append((x, int(member)))
    return out


def link_forest(fps: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Spanning links (a, b) among the distinct longs of column ``fp``, within ``radius`` bits.

    ``radius`` is at most 3: then two of the five blocks agree.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the sharding holds for radii up to 3")
    masks = [((1 << n) - 1) << at for at, n in BLOCKS]
    pairs = [(masks[a] | masks[b]) for a, b in combinations(range(len(BLOCKS)), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in pairs]
    keys = fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("pair"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)])
        ).alias("k"),
    ).select("k.pair", "k.bits", "fp")
    crowded = materialize(
        keys.groupBy("pair", "bits").agg(F.count("*").alias("n")).where(F.col("n") > cell), "crowded"
    )
    cells = keys.withColumn("cell", F.lit("0"))
    if crowded.head(1):
        tiles = F.ceil(F.col("n") / cell).cast("int")
        own = F.pmod(F.xxhash64("fp"), tiles)
        other = F.explode(F.sequence(F.lit(0).cast("long"), (tiles - 1).cast("long")))
        hot = keys.join(crowded, ["pair", "bits"]).withColumn("own", own).withColumn("other", other)
        hot = hot.select("pair", "bits", "fp", F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
        cells = cells.join(crowded, ["pair", "bits"], "left_anti").unionByName(hot)

    def run(batches):
        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, part]) if rest is not None else part
            done, rest = _whole_runs(table)
            yield from _linked(done, radius)
        if rest is not None:
            yield from _linked(rest, radius)

    bounded_batches(fps.sparkSession)
    return (
        cells.select(F.xxhash64("pair", "bits", "cell").alias("shard"), "fp")
        .repartition("shard")
        .sortWithinPartitions("shard", "fp")
        .mapInArrow(run, "a long, b long")
    )


def _whole_runs(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Split off the last shard of the table, of which more rows may come."""
    shard = table.column("shard").to_numpy()
    cut = int(np.searchsorted(shard, shard[-1])) if len(shard) else 0
    return table.slice(0, cut), table.slice(cut).combine_chunks()


def _linked(table: pa.Table, radius: int):
    shard, fp = table.column("shard").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else np.zeros(0, int)
    ends = np.append(starts[1:], len(shard))
    many = ends - starts > 1
    found = [x for a, b in zip(starts[many], ends[many], strict=True) for x in _forest(np.unique(fp[a:b]), radius) if b - a > 1]
    if found:
        pair = np.array(found, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


def near_duplicates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), radius: int = RADIUS) -> DataFrame:
    """Columns ``keep``, ``fp`` and ``root`` of every row; rows of one component share ``root``.

    ``root`` is a fingerprint of the component.  Copies share a fingerprint and so collapse
    before anything is linked.  Tables without rows give none; repeated rows stay repeated.
    """
    fps = materialize(fingerprints(docs, text, keep), "fps")
    distinct = materialize(fps.groupBy("fp").agg(F.count("*").alias("copies")), "distinct")
    labels = materialize(components(link_forest(distinct.select("fp"), radius)), "labels")
    table = distinct.select("fp").join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    table = materialize(table.select("fp", F.coalesce("root", "fp").alias("root")), "roots")
    return fps.join(table, "fp")


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest id that links reach, its own included.

    Rows without id take part and may get the id of their component; a component without
    any id has a null one.  Empty and null texts share fingerprint zero, linked like others.
    """
    rows = materialize(near_duplicates(docs, text, (doc_id,), radius), "grouped")
    least = materialize(rows.groupBy("root").agg(F.min(doc_id).alias("component_id")), "least")
    return rows.join(least, "root").select(
        doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def min_hashes(h: np.ndarray) -> np.ndarray:
    """A key for each MinHash band of different shingle hashes; texts without shingles share theirs."""
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14), None] * odd
        least = np.minimum(least, (part ^ (part >> np.uint64(31))).min(axis=0))
    mixed = least * odd[::-1]
    keys = (mixed ^ (mixed >> np.uint64(29))).reshape(BANDS, BAND).sum(axis=1, dtype=np.uint64)
    return (keys + np.arange(BANDS, dtype=np.uint64) * odd[0]).view(np.int64)


def sketches(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, fp (of five-word shingles), n (different shingles) and the keys of the bands of every row."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(*keep, F.col(text).alias("__text"))
    new = {"fp": "long", "n": "long", "bands": "array<long>"}
    schema = docs.select(*keep, *[F.lit(None).cast(t).alias(c) for c, t in new.items()]).schema

    def run(batches):
        for batch in batches:
            hashes = [shingles(t, COPY_WORDS) for t in utf8(batch.column(batch.num_columns - 1))]
            fps = np.array([majority(h) for h in hashes], dtype=np.uint64).view(np.int64)
            sets = [np.unique(h.astype(np.uint64)) for h in hashes]
            arrays = [pa.array(fps), pa.array([len(h) for h in sets], pa.int64()), pa.array([min_hashes(h) for h in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=schema.names)

    return slim.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, shingles): the different shingle hashes of each text, ascending."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            held = [np.unique(shingles(t, COPY_WORDS).astype(np.uint64)).view(np.int64) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int64()))], names=["key", "shingles"])

    return docs.select(F.col(key).alias("key"), text).mapInArrow(run, "key long, shingles array<long>")


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    if COPY_SIMILARITY * max(len(a), len(b)) > min(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= COPY_SIMILARITY * (len(a) + len(b) - common)


def _confirmed(keys: np.ndarray, fps: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between the texts of a cell that make the same groups as all its confirmed links do."""
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    order = np.argsort(fps, kind="stable")
    members, first = np.unique(fps[order], return_index=True)
    same = dict(zip(members.tolist(), np.split(order, first[1:]), strict=True))  # texts of each fingerprint

    def compare(mine, others):
        for a in mine.tolist():
            for b in others.tolist():
                x, y = find(a), find(b)
                if x != y and _alike(sets[a], sets[b]):
                    parent[x] = y
                    out.append((int(keys[a]), int(keys[b])))

    for member, near in BKTree(members).links(members, COPY_RADIUS):
        for other in near.tolist():
            if other <= member:
                compare(same[int(member)], same[other])
    return out


def copy_links(table: DataFrame, docs: DataFrame, text: str, key: str, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Links (a, b) among the keys of ``table`` (key, fp, n, bands; a row a text): near copies that
    share a bucket.  ``docs`` has the texts and their keys.

    Buckets of the same texts count once.  The shingles of texts in a bucket with others are made
    again and shuffled to it, those of crowded buckets to each pair of tiles.
    """
    met = materialize(table.select("key", "fp", "n", F.explode(F.array_distinct("bands")).alias("bucket")), "buckets")
    sums = met.groupBy("bucket").agg(F.count("*").alias("texts"), F.sum("n").alias("size"), F.bit_xor(F.xxhash64("key")).alias("x"), F.min("key").alias("least"), F.max("key").alias("most"))
    sums = sums.where("texts > 1").groupBy("texts", "size", "x", "least", "most").agg(F.min("bucket").alias("bucket"))
    sums = materialize(sums.select("bucket", F.greatest(F.lit(1), F.ceil(F.col("size") * 16 / cell_bytes)).cast("int").alias("tiles")), "crowds")
    members = materialize(met.join(sums, "bucket"), "members")
    wanted = materialize(members.select("key").distinct(), "wanted")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    mine = docs.select(F.col(key).alias("__key"), F.col(text).alias("__body")).join(side, F.col("__key") == F.col("key"), "left_semi")
    sets = shingle_sets(mine, "__body", "__key").dropDuplicates(["key"])
    own = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    cells = members.withColumn("own", own).withColumn("other", other)
    cells = cells.select("key", "fp", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))

    def run(batches):
        held, cell = [], None
        for batch in batches:
            at = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a and at[a] != cell:
                    yield from linked(held)
                    held, cell = [], at[a]
                if b > a:
                    held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        yield from linked(held)

    def linked(held):
        rows = pa.concat_tables(held).combine_chunks() if held else None
        if rows is None or len(rows) < 2:
            return
        column = rows.column("shingles").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        flat, ends = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy()
        sets = np.split(flat, (ends - ends[0])[1:-1])
        found = _confirmed(rows.column("key").to_numpy(), rows.column("fp").to_numpy().view(np.uint64), sets)
        if found:
            pair = np.array(found, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    bounded_batches(docs.sparkSession)
    dealt = cells.join(sets, "key").select("cell", "key", "fp", "shingles").repartition("cell").sortWithinPartitions("cell", "key")
    return dealt.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(id, key, root) of every row: its id, the hash of its text, and the hash of one text of its group.

    Groups are those that links between texts of five-word similarity 0.8 or more make; each such
    link is exact, and one of just 0.8 is found with probability 0.98.  Texts without words are alike.
    """
    keyed = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("__text"))
    rows = materialize(sketches(keyed, "__text", ("id", "key")), "sketches")
    table = rows.select("key", "fp", "n", "bands").dropDuplicates(["key"])
    labels = materialize(components(copy_links(table, keyed, "__text", "key")), "labels")
    return rows.select("id", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").select("id", "key", F.coalesce("root", "key").alias("root"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with one row left of each group of near copies: that of the smallest id.

    Rows without id stay only if their group has no id at all; repeated rows collapse.  The texts are
    shuffled only where the rows to leave out are too many to broadcast.
    """
    rows = materialize(near_copies(docs, text, doc_id), "grouped")
    first = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "key")).alias("first")
    kept = rows.groupBy("root").agg(first).select(F.xxhash64("first.id").alias("__id"), F.col("first.key").alias("__key"), F.lit(True).alias("stays"))
    counted = rows.groupBy(F.xxhash64("id").alias("__id"), F.col("key").alias("__key")).agg(F.count("*").alias("rows"))
    told = materialize(counted.join(kept, ["__id", "__key"], "left").select("__id", "__key", F.coalesce("stays", F.lit(False)).alias("stays"), "rows"), "told")
    out = docs.withColumns({"__id": F.xxhash64(doc_id), "__key": F.xxhash64(text)})
    odd = told.where("NOT stays OR rows > 1")
    if odd.count() > BROADCAST_KEYS:
        once = out.join(told.where("stays").select("__id", "__key"), ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"])
    else:
        once = out.join(F.broadcast(odd.select("__id", "__key")), ["__id", "__key"], "left_anti")
        repeated = told.where("stays AND rows > 1").select("__id", "__key")
        if repeated.head(1):
            once = once.unionByName(out.join(F.broadcast(repeated), ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"]))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
