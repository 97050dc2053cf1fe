"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words.  A bounded sample of labelled documents serves as the
examples, and all their terms span the space; document frequencies are counted over all documents.
A weight is (1 + ln tf) * idf * relevance.  Relevance, from the log-likelihood ratio of a term
between the classes, raises what tells them apart above the words that every text has; it is
nowhere 0, so no term is left out.  The examples stand in an inverted index whose lists are cut into
blocks, each with its largest weight.  A search sums those maxima to a bound per block, visits
blocks by falling bound, and stops when no block can beat its kth neighbour, so the k nearest
are exact.  Their similarity-weighted votes, with the base rate as one weak vote, give the score
and the neighbours are its evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import bounded_batches, bucket, materialize, readable, utf8

#: Labelled documents that each class gives to the sample, picked by a hash.
PER_CLASS = 1500
#: Log-likelihood ratio (G squared) of full relevance, which leaves about one term in 100,000 to
#: chance, and the least relevance of a term.
RATIO, LEAST = 20.0, 0.03
NEIGHBOURS = 15
BLOCK = 64
#: Blocks that the first round of a search visits; each round doubles the number.
FIRST_BLOCKS = 12
#: Similarity of five-word shingles from which examples of one label count as one.
SAME = 0.8
#: Weight of the base rate among the votes.
BASE_VOTE = 0.25
THRESHOLD = 0.7
WORDS = re.compile(r"[^\W\d_]+")
#: Multipliers of the four MinHash values that bring like examples together.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of each word."""
    return Counter(WORDS.findall(readable(text).lower()))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learnt from: crc32 of the id as text, modulo 3, is 1 (null ids never)."""
    return F.coalesce(bucket(doc_id, 3) == 1, F.lit(False))


def sample(labels: DataFrame, doc_id: str, label: str, most: int = PER_CLASS) -> DataFrame:
    """(id, y, weight): about ``most`` labelled ids of each class by a hash; the weight is the
    number of labelled documents that each stands for.  Of several labels of an id the largest counts."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    known = materialize(known, "labels")
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, F.lit(min(1.0, most / sizes.get(1, 1)))).otherwise(F.lit(min(1.0, most / sizes.get(0, 1))))
    spread = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    return known.where(spread < share).withColumn("weight", 1 / share)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + count), one range after the other."""
    ends = np.cumsum(counts)
    out = np.repeat(starts - ends + counts, counts)
    out += np.arange(len(out))
    return out


@dataclass
class Model:
    """Terms with their relevance and, once built, the block-max index over the examples."""

    vocabulary: dict[str, int]
    relevance: np.ndarray
    base: float
    examples: list[tuple] = field(default_factory=list)  # (id, y, weight, terms, tf)

    def terms(self, text: bytes | None) -> dict[int, int]:
        """Known terms of a text and how often it has them."""
        known = self.vocabulary
        return {known[t]: n for t, n in term_counts(text).items() if t in known}

    def build(self, documents: int, frequency: np.ndarray) -> None:
        self.heft = (np.log((1 + documents) / (1 + frequency)) + 1) * self.relevance
        vectors = [(e, *self.vector(dict(zip(e[3], e[4], strict=True)))) for e in self.examples if len(e[3])]
        # By the heaviest terms, so that examples of a block are alike and its largest weights bound it closely.
        heavy = lambda x: (*x[1][np.argsort(-x[2], kind="stable")[:3]].tolist(), -1, -1, -1)[:3]
        vectors.sort(key=lambda x: (heavy(x), x[0][0]))
        self.examples = []
        self.ids = [x[0][0] for x in vectors]
        self.y = np.array([x[0][1] for x in vectors], dtype=float)
        self.weight = np.array([x[0][2] for x in vectors], dtype=float)
        self.blocks = -(-len(vectors) // BLOCK)
        term = np.concatenate([np.zeros(0, np.int64), *[x[1] for x in vectors]])
        at = np.repeat(np.arange(len(vectors)), [len(x[1]) for x in vectors])
        order = np.argsort(term, kind="stable")  # examples ascend within a term
        self.at, self.value = at[order], np.concatenate([np.zeros(0), *[x[2] for x in vectors]])[order]
        # One list for each term and block that meet: where its postings start, and their largest value.
        key = term[order] * max(self.blocks, 1) + self.at // BLOCK
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        self.start = np.append(first, len(key))
        self.block = key[first] % max(self.blocks, 1)
        self.peak = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0)
        self.lists = np.searchsorted(key[first] // max(self.blocks, 1), np.arange(len(self.vocabulary) + 1))

    def vector(self, terms: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and their weights at unit length."""
        ids = np.fromiter(terms.keys(), np.int64, len(terms))
        value = (1 + np.log(np.fromiter(terms.values(), float, len(terms)))) * self.heft[ids]
        order = np.argsort(ids)
        return ids[order], value[order] / np.sqrt((value**2).sum())

    def nearest(self, terms: dict[int, int], k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """(similarity, example) of the k most similar examples; ties to the earlier one."""
        if not terms or not self.blocks:
            return []
        ids, value = self.vector(terms)
        counts = self.lists[ids + 1] - self.lists[ids]
        lists = _ranges(self.lists[ids], counts)
        value, block = np.repeat(value, counts), self.block.take(lists)
        begin = self.start.take(lists)
        length = self.start.take(lists + 1) - begin
        bound = np.bincount(block, value * self.peak.take(lists), self.blocks)
        order = np.argsort(-bound, kind="stable")
        kth, size, done = 0.0, FIRST_BLOCKS, 0
        rows, found = np.zeros(0, np.int64), np.zeros(0)
        while done < self.blocks:
            chosen = order[done : done + size]
            chosen = chosen[(bound[chosen] > 0) & (bound[chosen] >= kth - 1e-12)]
            if not len(chosen):
                break
            open_ = np.zeros(self.blocks, dtype=bool)
            open_[chosen] = True
            mine = np.flatnonzero(open_.take(block))
            starts, many = begin.take(mine), length.take(mine)
            posts = _ranges(starts, many)
            weight = np.repeat(value.take(mine), many)
            weight *= self.value.take(posts)
            scores = np.bincount(self.at.take(posts), weight, len(self.ids))
            fresh = np.flatnonzero(scores > max(kth - 1e-12, 0.0))
            rows, found = np.concatenate((rows, fresh)), np.concatenate((found, scores[fresh]))
            best = np.lexsort((rows, -found))[:k]
            rows, found = rows[best], found[best]
            kth = found[-1] if len(found) == k else 0.0
            done, size = done + size, 2 * size
        return list(zip(found.tolist(), rows.tolist(), strict=True))

    def score(self, terms: dict[int, int]) -> tuple[float, list[tuple[float, int]]]:
        """Probability of label 1 and the neighbours that voted; the base rate where none does."""
        near = self.nearest(terms)
        votes = np.array([s for s, _ in near]) * self.weight[[i for _, i in near]] if near else np.zeros(0)
        toxic = float((votes * self.y[[i for _, i in near]]).sum()) if near else 0.0
        return (toxic + BASE_VOTE * self.base) / (float(votes.sum()) + BASE_VOTE), near


def shingles(text: bytes | None) -> np.ndarray:
    """Hashes of the different five-word shingles of a text."""
    words = (text or b"").lower().split()
    return np.array(sorted({xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))}), dtype=np.uint64)


def _alike(table: pa.Table) -> pa.Table:
    """(id, first): links that hold together the examples of a bucket that are alike, fewer than it has examples.

    Every example meets every other that no links join to it yet, so none hides behind a third."""
    order = table.column("id").to_numpy().argsort(kind="stable")
    ids, held = table.column("id").take(pa.array(order)).to_pylist(), table.column("shingles").take(pa.array(order))
    sets = [np.asarray(s.values.to_numpy(zero_copy_only=False)) for s in held]
    family, out = list(range(len(ids))), []
    for i in range(len(ids)):
        for j in range(i):
            few, many = sorted((len(sets[i]), len(sets[j])))
            if family[i] == family[j] or few < SAME * many:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common >= SAME * (few + many - common):
                out.append((ids[i], ids[j]))
                old, new = max(family[i], family[j]), min(family[i], family[j])
                family = [new if f == old else f for f in family]
    kind = table.column("id").type
    return pa.table([pa.array([x[n] for x in out], kind) for n in (0, 1)], names=["id", "first"])


def merge_copies(rows: DataFrame) -> DataFrame:
    """The sampled examples (id, y, weight, text) without near copies of one label.

    Copies would make any of their words look typical of a class.  Examples of one label that share one
    of four MinHash values and five-word shingles to ``SAME`` or more are one, compared each with each in a bucket
    of the bounded sample; the smallest id stays, with the weights of all.
    """

    def run(batches):
        for batch in batches:
            held = [shingles(t) for t in utf8(batch.column(2))]
            least = [(h[:, None] * ODD).min(axis=0).view(np.int64) for h in held]
            arrays = [batch.column(0), batch.column(1), pa.array(least, pa.list_(pa.int64())), pa.array([h.view(np.int64) for h in held], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "y", "least", "shingles"])

    schema = rows.select("id", "y", *[F.lit(None).cast("array<long>").alias(c) for c in ("least", "shingles")]).schema
    hashed = materialize(rows.select("id", "y", "text").mapInArrow(run, schema), "shingles")
    met = hashed.select("id", "y", "shingles", F.posexplode("least").alias("nth", "value"))
    links = met.groupBy("y", "nth", "value").applyInArrow(_alike, hashed.select("id", F.col("id").alias("first")).schema)
    alike = links.distinct().collect()  # four an example at most
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for r in alike:
        a, b = sorted((find(r["id"]), find(r["first"])))
        parent[b] = a
    named = rows.sparkSession.createDataFrame([(x, find(x)) for x in list(parent)], rows.select("id", F.col("id").alias("first")).schema)
    told = rows.join(F.broadcast(named), "id", "left").withColumn("first", F.coalesce("first", "id"))
    weights = told.groupBy("first").agg(F.sum("weight").alias("weight"))
    return told.where("id = first").drop("weight").join(weights, "first").select("id", "y", "weight", "text")


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", most: int = PER_CLASS) -> Model:
    """All terms of the sampled examples, and these; ``finish`` builds the index."""
    bounded_batches(docs.sparkSession)
    picked = F.broadcast(sample(labels, doc_id, label, most))  # at most about 2 * most narrow rows
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(picked, "id")
    # One text of each id, so that an id of very many rows is no more than one example.
    rows = rows.groupBy("id").agg(F.min("y").alias("y"), F.min("weight").alias("weight"), F.min("text").alias("text"))
    rows = materialize(merge_copies(materialize(rows, "sampled")), "examples")
    sizes = {r.y: (r.n, r.w) for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                total.update((term, y) for term in term_counts(t))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())], names=["term", "y", "n"])

    ones, zeros = (float(sizes.get(y, (0, 0.0))[0]) for y in (1, 0))
    per_term = rows.select("y", "text").mapInArrow(count, "term string, y int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).cast("double").alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).cast("double").alias("b")
    )
    part = lambda n, total, share: F.when(n > 0, n * F.log(n / (total * share))).otherwise(0.0)
    a, b, share = F.col("a"), F.col("b"), (F.col("a") + F.col("b")) / F.lit(max(ones + zeros, 1.0))
    ratio = 2 * (part(a, F.lit(ones), share) + part(b, F.lit(zeros), share) + part(ones - a, F.lit(ones), 1 - share) + part(zeros - b, F.lit(zeros), 1 - share))
    told = per_term.select("term", ratio.alias("ratio")).toArrow()  # the terms of a bounded sample
    names, ratios = told.column("term").to_pylist(), told.column("ratio").to_numpy()
    order = sorted(range(len(names)), key=names.__getitem__)
    weigh, hits = {y: sizes.get(y, (0, 0.0))[1] or 0.0 for y in (0, 1)}, np.clip((ratios[order] / RATIO) ** 2, LEAST, 1.0)
    model = Model({names[i]: n for n, i in enumerate(order)}, hits, (weigh[1] + 1) / (weigh[0] + weigh[1] + 2))

    def known(batches):
        for batch in batches:
            found = [model.terms(t) for t in utf8(batch.column(3))]
            arrays = [*batch.columns[:3], pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "y", "weight", "terms", "tf"])

    schema = rows.select("id", "y", "weight", F.lit(None).cast("array<int>").alias("terms"), F.lit(None).cast("array<int>").alias("tf")).schema
    model.examples = [tuple(r) for r in rows.mapInArrow(known, schema).collect()]
    return model


def term_table(docs: DataFrame, model: Model, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Stores ``keep``, known terms and tf of every document, from whole texts."""
    slim = docs.select(*keep, F.col(text).alias("__text"))
    schema = docs.select(*keep, *[F.lit(None).cast("array<int>").alias(c) for c in ("terms", "tf")]).schema

    def run(batches):
        for batch in batches:
            found = [model.terms(t) for t in utf8(batch.column(batch.num_columns - 1))]
            offsets = pa.array(np.cumsum([0, *[len(f) for f in found]]).astype(np.int32))
            flat = [np.array([x for f in found for x in part(f)], dtype=np.int32) for part in (dict.keys, dict.values)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in flat]], names=schema.names)

    return materialize(slim.mapInArrow(run, schema), "terms")


def _rows(batch: pa.RecordBatch, terms: int, tf: int):
    """The terms of each row of a stored table, with how often the text has them."""
    ids, counts = batch.column(terms).flatten().to_numpy(), batch.column(tf).flatten().to_numpy()
    ends = batch.column(terms).offsets.to_numpy()
    ends = ends - ends[0] if len(ends) else ends
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield dict(zip(ids[a:b].tolist(), counts[a:b].tolist(), strict=True))


def finish(model: Model, table: DataFrame) -> Model:
    """Builds the index with the document frequencies of a stored table of all documents."""
    size = len(model.vocabulary)

    def run(batches):
        total = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            total[:size] += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)[:size]
            total[size] += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"])

    _built(model, table.select("terms").mapInArrow(run, "term int, n long"))
    return model


def _built(model: Model, counted: DataFrame) -> None:
    size = len(model.vocabulary)
    found = counted.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, dtype=np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    model.build(int(out[size]), out[:size])


def finish_by_reading(model: Model, docs: DataFrame, text: str) -> Model:
    """``finish`` where no table is stored, since whole rows are to be filtered: the texts are read twice."""
    known, size = model.vocabulary, len(model.vocabulary)

    def run(batches):
        total = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for t in utf8(batch.column(0)):
                total[[known[w] for w in set(WORDS.findall(readable(t).lower())) if w in known]] += 1
            total[size] += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"])

    _built(model, docs.select(text).mapInArrow(run, "term int, n long"))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """One row per document: its id, ``score`` (0 to 1), ``evidence``: its nearest examples as
    structs of doc_id, label and similarity, nearest first.

    ``labels`` holds the labels to learn from, and no others.  Null, empty and term-less texts get
    the base rate and no evidence, as do all texts if nothing was labelled (then 0.5).  Ill-formed
    stretches part words.  Repeated documents score alike; ties go to the example that stands first.
    """
    model = train(docs, labels, text, doc_id, label)
    table = term_table(docs, model, text, (doc_id,))
    finish(model, table)
    kind = dict(docs.dtypes)[doc_id]
    evidence = F.lit(None).cast(f"array<struct<doc_id:{kind},label:int,similarity:double>>").alias("evidence")
    schema = docs.select(doc_id, F.lit(0.0).alias("score"), evidence).schema

    def run(batches):
        for batch in batches:
            found = [model.score(t) for t in _rows(batch, 1, 2)]
            near = [[{"doc_id": model.ids[i], "label": int(model.y[i]), "similarity": s} for s, i in x[1]] for x in found]
            struct = pa.struct([("doc_id", batch.column(0).type), ("label", pa.int32()), ("similarity", pa.float64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array(near, pa.list_(struct))], names=schema.names)

    return table.mapInArrow(run, schema)


def reject(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below ``threshold``; columns unchanged."""
    model = finish_by_reading(train(docs, labels, text, doc_id, label), docs, text)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            clean = [model.score(model.terms(t))[0] < threshold for t in utf8(batch.column(at))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
