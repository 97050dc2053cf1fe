"""Personal data, and the terms that give it away: information-theoretic sanitisation.

Patterns find the entities: mail and IP addresses, card and phone numbers.  A term near an
entity may reveal it although it is no personal data itself.  How strongly it does is
estimated from the corpus: the pointwise mutual information of term and entity over the
information of the entity is 1 if the term never stands elsewhere.  Terms at or above the
disclosure threshold become spans of kind ``term`` wherever they stand, and are generalised by
``redact``.

One pass over the texts stores the words around each entity and the number of times each word
occurs at all; joins of these tables give the terms.  A second pass finds the places of the
terms: a bitmap of bounded size drops most other words, a join by term the rest.
Entities leave the passes only as hashes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import bounded_batches, materialize, readable, utf8

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on each side of an entity that may reveal it.
REACH = 8
#: Share of an entity's information that a term may give away, and how often the two must meet.
DISCLOSURE, SUPPORT = 0.95, 3
#: Different words that a task counts before it passes its counts on.
COUNTED = 300_000
#: Bits of the map that the second pass looks words up in; only speed depends on it.
BITS = 1 << 23

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive, and only from the start of a run of digits: linear in texts of any length.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORDS = re.compile(r"[^\W_]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of mail addresses, found from each ``@`` outwards."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            out.append((start, end))
        at = text.find("@", max(end, at + 1))
    return out


def luhn(digits: str) -> bool:
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, entity) of the patterned personal data, ordered by start and kind."""
    out = [(0, a, b, text[a:b].lower()) for a, b in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((1, *m.span(), ".".join(parts)))
    for m in CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span(), d))
    for m in PHONE.finditer(text):
        if 9 <= len(d := _digits(m[0])) <= 15:
            out.append((3, *m.span(), d))
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def _hash(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text)).view(np.int64))


def context(text: str, spans: list[tuple[int, int, int, str]], reach: int = REACH) -> list[tuple[int, int, int, int]]:
    """(term, entity, start, end) of the words within ``reach`` words of each span, outside all spans."""
    out, starts, ends = [], [], []
    for _, start, end, _ in spans:  # ordered by start: merge what overlaps
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    words = [m.span() for m in WORDS.finditer(text)] if spans else []
    begins, stops = [w[0] for w in words], [w[1] for w in words]

    def outside(start: int, stop: int) -> bool:
        i = bisect_left(starts, stop) - 1  # the last stretch that begins before the word ends
        return i < 0 or ends[i] <= start

    for kind, start, end, entity in spans:
        before, after = bisect_right(stops, start), bisect_left(begins, end)
        name = _hash(f"{kind}:{entity}")
        for a, b in words[max(0, before - reach) : before] + words[after : after + reach]:
            if outside(a, b):
                out.append((_hash(text[a:b].lower()), name, a, b))
    return out


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
NEAR = pa.struct([("term", pa.int64()), ("entity", pa.int64())])
PLACE = pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
def scan(docs: DataFrame, text: str, reach: int = REACH) -> DataFrame:
    """Stores a row for each document with entities (``near``) and rows (``term``, ``n``) that count
    words; the rows of a kind have nulls in the columns of the other."""
    bounded_batches(docs.sparkSession)
    names = ["near", "term", "n"]

    def counted(words: Counter):
        # Each word in lower case by itself, as it is marked: lower-casing a text may part a word.
        terms = pa.array(np.array([xxhash.xxh64_intdigest(w.lower()) for w in words], dtype=np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.nulls(len(terms), pa.list_(NEAR)), terms, pa.array(list(words.values()), pa.int64())], names=names)

    def run(batches):
        words = Counter()
        for batch in batches:
            texts = [readable(t) for t in utf8(batch.column(0)) if t]
            near = [context(t, s, reach) for t in texts if (s := base_spans(t))]
            near = pa.array([[{"term": x[0], "entity": x[1]} for x in s] for s in near], pa.list_(NEAR))
            yield pa.RecordBatch.from_arrays([near, pa.nulls(len(near), pa.int64()), pa.nulls(len(near), pa.int64())], names=names)
            for t in texts:
                words.update(WORDS.findall(t))
                if len(words) > COUNTED:
                    yield counted(words)
                    words = Counter()
        if words:
            yield counted(words)

    return materialize(docs.select(text).mapInArrow(run, "near array<struct<term:long,entity:long>>, term long, n long"), "entities")


def places(text: str, spans: list[tuple[int, int, int, str]], known) -> list[tuple[int, int, int]]:
    """(term, start, end) of all words outside the spans whose hash ``known`` lets through."""
    terms = {w: h for w in set(WORDS.findall(text)) if known(h := _hash(w.lower()))}
    if not terms:
        return []
    out, i, end = [], 0, 0
    for m in WORDS.finditer(text):
        if m[0] in terms:
            while i < len(spans) and spans[i][1] < m.end():
                end = max(end, spans[i][2])
                i += 1
            if end <= m.start():
                out.append((terms[m[0]], *m.span()))
    return out


def locate(docs: DataFrame, text: str, keep: tuple[str, ...], terms: DataFrame) -> DataFrame:
    """Stores ``keep``, ``rid``, ``base`` and ``places`` of every row.  The places are those of
    ``terms``, and of other words that share a bit with one."""
    bounded_batches(docs.sparkSession)
    bits = np.zeros(BITS, dtype=bool)
    bits[terms.select(F.pmod("term", F.lit(BITS)).alias("bit")).distinct().toArrow().column("bit").to_numpy()] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    slim = docs.select(*keep, F.col(text).alias("__text"))
    new = {"rid": "long", "base": "array<struct<start:int,kind:int,end:int>>", "places": "array<struct<term:long,start:int,end:int>>"}
    schema = docs.select(*keep, *[F.lit(None).cast(t).alias(n) for n, t in new.items()]).schema

    def known(h: int) -> int:
        bit = h % BITS
        return packed[bit >> 3] >> (bit & 7) & 1

    def run(batches):
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [readable(t) for t in utf8(batch.column(batch.num_columns - 1))]
            base = [base_spans(t) for t in texts]
            found = [places(t, s, known) for t, s in zip(texts, base, strict=True)]
            arrays = [
                pa.array(np.arange(rid, rid + len(texts))),
                pa.array([[{"start": a, "kind": k, "end": b} for k, a, b, _ in s] for s in base], pa.list_(SPAN)),
                pa.array([[dict(zip(("term", "start", "end"), x, strict=True)) for x in s] for s in found], pa.list_(PLACE)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=schema.names)
            rid += len(texts)

    return materialize(slim.mapInArrow(run, schema), "places")


def disclosing(near: DataFrame, counts: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(term, entity, share) of the pairs at or above the threshold.

    ``near`` has a row (term, entity) for each meeting, ``counts`` (term, n) for all words of the
    corpus.  The share is PMI(term; entity) over the information of the entity.
    """
    pairs = near.groupBy("term", "entity").agg(F.count("*").alias("both"))
    pairs = materialize(pairs, "pairs")
    entities = pairs.groupBy("entity").agg(F.sum("both").alias("around"))
    met = materialize(pairs.where(F.col("both") >= support), "met")
    terms = counts.join(met.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    rows = met.join(terms, "term").join(entities, "entity")
    information = -F.log2(F.col("around") / total)
    # Words that one pass counts twice near two mentions cannot push a probability above 1.
    both = F.least("both", "n", "around")
    pmi = F.log2(both * F.lit(total) / (F.col("n") * F.col("around")))
    share = F.when(information > 0, pmi / information).otherwise(0.0)
    return rows.select("term", "entity", share.alias("share")).where(F.col("share") >= disclosure)


def find_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """Columns ``keep`` of every row, ``base`` and ``spans``: arrays of structs (start, kind, end)
    in code points, by start and kind; kinds are numbered as in ``KINDS``, and ``spans`` holds
    ``base`` and the disclosing terms.

    Null and empty texts have empty arrays; places in an ill-formed text are those in
    ``make_valid_utf8`` of it.  Repeated rows stay apart and each counts in the corpus.
    """
    table = scan(docs, text)
    near = table.where("near IS NOT NULL").select(F.explode("near").alias("x")).select("x.*")
    pairs = disclosing(near, table.where("term IS NOT NULL").select("term", "n"), disclosure, support)
    terms = materialize(pairs.select("term").distinct(), "disclosing")
    rows = locate(docs, text, keep, terms)
    found = rows.select("rid", F.explode("places").alias("x")).select("rid", "x.*")
    told = found.join(terms, "term").groupBy("rid").agg(
        F.collect_list(F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end")).alias("terms")
    )
    out = rows.drop("places").join(told, "rid", "left")
    both = F.array_sort(F.concat("base", F.coalesce("terms", F.lit(None).cast("array<struct<start:int,kind:int,end:int>>"), F.filter("base", lambda _: F.lit(False)))))
    return out.select(*keep, "base", both.alias("spans"))


def listed(spans: str):
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count_of(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span generalised to its kind, as in ``[email]``; null texts stay
    null, and ill-formed stretches become U+FFFD.

    Of overlapping spans the first one covers the stretch that both share.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    found = find_spans(packed, keep=("row",)).withColumn("text", F.make_valid_utf8(F.col("row").getField(text)))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        label = F.concat(F.lit("["), F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), F.lit("]"))
        before = F.substr(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.concat(acc["out"], before, F.when(fresh, label).otherwise("")).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.reduce("spans", start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1)))
    new = F.when(F.col("text").isNotNull(), done)
    return found.select(*[new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
