"""Benchmark decontamination with a positional inverted index over the documents.

The index knows nothing of any benchmark: for each document it stores every term, as a 64-bit
hash, with its position list, and any number of benchmarks can be searched for in it later.  It
is dealt by document, so the lists that a phrase needs lie together: it is built by the tasks that
read the text, and neither texts nor lists are shuffled.  A phrase is found from its rarest terms
on: the position lists, less their offsets, are intersected in the order of corpus frequency, and
the search ends at the first empty list.

A benchmark is searched for in parts of bounded size; only the part at hand is on the driver.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import bounded_batches, materialize, utf8

WINDOW = 10
#: Bytes of benchmark text that the driver and each worker hold at a time.  Its windows take some 220 bytes of the
#: driver's memory and 40 of a task's closure for each byte, so a larger benchmark goes in more parts.
BENCHMARK_BYTES = 2 << 20
#: Keys of contaminated texts that are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: Every ASCII byte that is no letter or digit parts words; A-Z are lower-cased.
TABLE = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32) for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; null has none.  Ill-formed bytes are part of words."""
    return text.translate(TABLE).split() if text else []


def terms_of(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text, in order."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words_of(text)], dtype=np.uint64).view(np.int64)


def postings(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different terms ascending, lengths of their position lists, and the lists one after the other."""
    at = np.argsort(terms, kind="stable").astype(np.int32)
    ordered = terms[at]
    ends = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True)) + 1 if len(terms) else np.zeros(0, np.int64)
    return ordered[ends - 1], np.diff(ends, prepend=0).astype(np.int32), at


def build_index(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Stores the positional index: ``keep``, rid, n_words, terms, lengths, positions of each document.

    ``rid`` numbers the rows of the index.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(*keep, F.col(text).alias("__text"))
    new = {"rid": "long", "n_words": "long", "terms": "array<long>", "lengths": "array<int>", "positions": "array<int>"}
    schema = docs.select(*keep, *[F.lit(None).cast(t).alias(n) for n, t in new.items()]).schema

    def run(batches):
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            found = [postings(terms_of(t)) for t in utf8(batch.column(batch.num_columns - 1))]
            counts = pa.array([len(x[2]) for x in found], pa.int64())
            arrays = [_lists([x[i] for x in found], t) for i, t in enumerate((np.int64, np.int32, np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.arange(rid, rid + len(found))), counts, *arrays], names=schema.names)
            rid += len(found)

    return materialize(slim.mapInArrow(run, schema), "postings")


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind)))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a list column, and where each row starts, the end last."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(), offsets - (offsets[0] if len(offsets) else 0)


class Phrases:
    """The windows of benchmark items, over the hashes of their terms."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.windows: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = terms_of(text).tolist()
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                self.windows[tuple(ids[i : i + window])].add(item)
        self.vocabulary = np.array(sorted({t for w in self.windows for t in w}), dtype=np.int64)

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each term in the vocabulary, and whether it is there at all."""
        if not len(self.vocabulary):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), bool)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        return at, self.vocabulary[at] == terms

    def plan(self, frequency: np.ndarray) -> None:
        """Order each window's terms from the rarest in the corpus; drop those that cannot occur."""
        known = dict(zip(self.vocabulary.tolist(), frequency.tolist(), strict=True))
        self.anchored: dict[int, list] = defaultdict(list)
        for ids, items in self.windows.items():
            if min(known[t] for t in ids):
                order = sorted(range(len(ids)), key=lambda i: (known[ids[i]], i))
                self.anchored[ids[order[0]]].append(([(i, ids[i]) for i in order], sorted(items)))
        self.anchors = np.array(sorted(self.anchored), dtype=np.int64)

    def match(self, lists: dict[int, np.ndarray], slop: int = 0) -> list[tuple[list[int], list[str]]]:
        """(positions of the words, items) of each occurrence of a window in a document, whose
        position lists of benchmark terms are given.

        With ``slop`` each word may stand up to so many words off its place; no position serves two words.
        """
        held: dict[int, set[int]] = {}

        def near(term: int) -> set[int]:
            if term not in held:
                held[term] = {p + d for p in lists[term].tolist() for d in range(-slop, slop + 1)}
            return held[term]

        out = []
        for anchor in lists:
            for (first, *others), items in self.anchored.get(anchor, ()):
                if any(t not in lists for _, t in others):
                    continue
                starts = {p - first[0] for p in near(anchor)}
                for i, term in others:
                    found = near(term)
                    starts = {s for s in starts if s + i in found}
                    if not starts:
                        break
                if slop:
                    placed = [_placed(s, sorted([first, *others]), lists, slop) for s in sorted(starts)]
                    out += [(p, items) for p in placed if p]
                else:
                    out += [(list(range(s, s + 1 + len(others))), items) for s in starts]
        return out


def _placed(start: int, window: list[tuple[int, int]], lists: dict[int, np.ndarray], slop: int) -> list[int] | None:
    """A position of its own for each word of a window; the places of equal words are taken in
    order, each the first that is left, which finds an assignment wherever there is one."""
    last: dict[int, int] = {}
    out = []
    for i, term in window:
        found = lists[term]
        at = bisect_left(found, max(start + i - slop, last.get(term, -1) + 1))
        if at == len(found) or found[at] > start + i + slop:
            return None
        last[term] = int(found[at])
        out.append(last[term])
    return sorted(out)


def term_frequency(index: DataFrame, found: Phrases) -> np.ndarray:
    """Occurrences in the whole corpus of each term of the vocabulary."""

    def run(batches):
        total = np.zeros(len(found.vocabulary), dtype=np.int64)
        for batch in batches:
            terms, lengths = _flat(batch.column(0))[0], _flat(batch.column(1))[0]
            at, known = found.places(terms)
            np.add.at(total, at[known], lengths[known])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"])

    counted = index.select("terms", "lengths").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(found.vocabulary), dtype=np.int64)
    table = counted.toArrow()
    out[table.column("term").to_numpy()] = table.column("n").to_numpy()
    return out


def _parts(benchmark: DataFrame, item_id: str, text: str, window: int):
    """The windows of the benchmark in parts of about ``BENCHMARK_BYTES`` at most, one after the
    other; an item longer than that is a part by itself.  Items without id or words have none."""
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 32)).first()[0] or 0
    n = 1 if size <= BENCHMARK_BYTES else 2 * -(-size // BENCHMARK_BYTES)  # uneven parts fit as well
    for part in range(n):
        mine = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == part)
        yield n, Phrases([(r.i, bytes(r.t)) for r in mine.collect()], window)


def search(index: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Adds to the rows of an index, in place of its lists, n_hit, hits and items: see ``contamination``."""
    keep = [c for c in index.columns if c not in ("rid", "n_words", "terms", "lengths", "positions")]
    schema = index.select(*keep, "rid", "n_words", *[F.lit(None).cast(t).alias(n) for n, t in {"hits": "array<int>", "items": "array<string>"}.items()]).schema

    def found_in(phrases: Phrases) -> DataFrame:
        phrases.plan(term_frequency(index, phrases))

        def run(batches):
            for batch in batches:
                cols = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
                (terms, edges), lengths, (at, begins) = _flat(cols["terms"]), _flat(cols["lengths"])[0], _flat(cols["positions"])
                ends = np.cumsum(lengths)
                row = np.repeat(np.arange(batch.num_rows), np.diff(edges))
                _, known = phrases.places(terms)
                open_ = np.unique(row[known & np.isin(terms, phrases.anchors)])
                hits: list[list[int]] = [[] for _ in range(batch.num_rows)]
                items: list[list[str]] = [[] for _ in range(batch.num_rows)]
                for r in open_.tolist():
                    mine = np.flatnonzero(known[edges[r] : edges[r + 1]]) + edges[r]
                    lists = {int(terms[i]): at[ends[i] - lengths[i] : ends[i]] for i in mine.tolist()}
                    matches = phrases.match(lists, slop)
                    hits[r] = sorted({p for ps, _ in matches for p in ps})
                    items[r] = sorted({i for _, names in matches for i in names})
                arrays = [cols[n] for n in (*keep, "rid", "n_words")] + [pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

        return index.mapInArrow(run, schema)

    parts = []
    for n, phrases in _parts(benchmark, item_id, text, window):
        rows = found_in(phrases)
        if n == 1:
            return rows.select(*keep, "rid", "n_words", F.size("hits").cast("long").alias("n_hit"), "hits", "items")
        parts.append(materialize(rows.where(F.size("hits") > 0).select("rid", "hits", "items"), "found"))
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    found = reduce(DataFrame.unionByName, parts).groupBy("rid").agg(merged("hits"), merged("items"))
    rows = index.select(*keep, "rid", "n_words").join(found, "rid", "left")
    none = {c: F.coalesce(c, F.array().cast(t)) for c, t in (("hits", "array<int>"), ("items", "array<string>"))}
    return rows.withColumns(none).select(*keep, "rid", "n_words", F.size("hits").cast("long").alias("n_hit"), "hits", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Columns ``keep`` of every document, n_words, n_hit, hits (positions of the words inside an
    occurrence of a benchmark window) and items (ids of the items found, as sorted strings).

    Null and empty texts have no words; an empty benchmark hits nothing; repeated documents
    and items are judged alike.  An item shorter than ``window`` words is one window.  Benchmarks may be of any size.
    """
    index = build_index(docs, text, keep)
    return search(index, benchmark, window=window, slop=slop).drop("rid")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without those that hold a benchmark window; columns unchanged.

    Texts are told by two hashes, of 96 bits together; only those of contaminated ones are joined back.
    """
    keys = (F.xxhash64(text).alias("__hash"), F.crc32(F.col(text).cast("binary")).alias("__crc"))
    index = build_index(docs.select(*keys, F.col(text).alias("__body")), "__body", ("__hash", "__crc"))
    bad = search(index, benchmark, window=window).where("n_hit > 0").select("__hash", "__crc").distinct()
    bad = materialize(bad, "contaminated")
    side = F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad
    same = (keys[0] == side["__hash"]) & (keys[1] == side["__crc"])
    return docs.join(side, same, "left_anti")
