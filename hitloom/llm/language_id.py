"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 4 to 0.  A text is charged its exact code
length in every tree under frozen statistics: a byte not seen in a context pays the escape
probability (method C) and is coded in the next shorter context, with the bytes that the longer ones
had excluded; bytes never seen fall to a uniform code.  The shortest code names the language.

The trees are sparse: each order is a sorted array of the contexts and bytes that training met.  What
is seen in a context is seen in every shorter one too, so what an escape excludes is a number that each
context holds.  Statistics do not change while a text is read, so the cost of a byte depends on
itself and the four bytes before it; a task looks each such gram up once and keeps its costs in a
table of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import bounded_batches, materialize, readable, utf8

ORDER = 4
#: Bytes of sampled text that a language, and all languages together, are learnt from.
TRAIN_BYTES, TRAIN_TOTAL = 2_000_000, 128_000_000
#: Symbols: 256 bytes, and one before the start of a text.
START, SYMBOLS = 256, 257
#: Costs that a task keeps, and that it sums at once.
KEPT, CHUNK = 1 << 22, 1 << 22
LETTER = regex.compile(r"\p{L}")
UND = "und"


def sample(labelled: DataFrame, text: str, lang: str, most: int, total: int = TRAIN_TOTAL) -> DataFrame:
    """About ``most`` bytes of different whole texts of each language, picked by a hash of the text.

    Copies count once.  Languages with less are taken whole, and each keeps at least one text.  Where
    the languages are so many that they would pass ``total``, each has its equal share of that.
    """
    named = labelled.select(F.col(text), F.col(lang).cast("string").alias(lang), F.xxhash64(F.lit("sample"), text).alias("__digest"))
    once = named.groupBy(F.col(lang).alias("__lang"), "__digest").agg(F.max(F.octet_length(text)).alias("bytes"))
    sums = materialize(once.groupBy("__lang").agg(F.sum("bytes").alias("__bytes"), F.min("__digest").alias("__first")), "languages")
    share = F.lit(min(most, total / max(1, sums.count()))) / F.greatest("__bytes", F.lit(1))
    spread = F.pmod(F.col("__digest"), F.lit(1 << 30)) / float(1 << 30)
    kept = named.join(sums, F.col(lang) == F.col("__lang")).where((spread < share) | (F.col("__digest") == F.col("__first")))
    return kept.dropDuplicates([lang, "__digest"]).select(text, lang)


def _grams(text: np.ndarray) -> np.ndarray:
    """Each symbol of a text with the four before it, as one number; the text's own start is marked."""
    b = np.concatenate((np.full(ORDER, START), text)).astype(np.int64)
    out = b[: len(text)]
    for i in range(1, ORDER + 1):
        out = out * SYMBOLS + b[i : i + len(text)]
    return out


def _pieces(text: bytes, size: int = CHUNK):
    """The grams of a text of any length, in pieces."""
    raw = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, len(raw), size):
        before = min(at, ORDER)
        yield _grams(raw[at - before : at + size])[before:]


def count_contexts(texts: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n): occurrences of each byte with the four before it."""
    bounded_batches(texts.sparkSession)

    def counted(one: str, part: list[np.ndarray]):
        grams, n = np.unique(np.concatenate(part), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([one] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    def run(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            held = utf8(batch.column(0))
            for one in sorted(set(langs)):
                size, part = 0, []
                for t in (t for t, x in zip(held, langs, strict=True) if x == one and t):
                    for piece in _pieces(t):
                        part.append(piece)
                        size += len(piece)
                        if size > CHUNK:
                            yield counted(one, part)
                            size, part = 0, []
                if part:
                    yield counted(one, part)

    found = texts.select(text, F.col(lang).cast("string")).mapInArrow(run, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number stands among sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Tree:
    """Context tree of one language: for each order the grams (context and byte) with their counts,
    and the contexts with total, number of kinds and what they exclude from the next shorter one."""

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        self.grams, self.counts, self.contexts, self.stats = [], [], [], []
        for order in range(ORDER + 1):
            key = grams % SYMBOLS ** (order + 1)
            real = key // SYMBOLS**order != START if order else np.ones(len(key), bool)  # contexts cut by the start are shorter ones
            keys, back = np.unique(key[real], return_inverse=True)
            counts = np.bincount(back, n[real], len(keys))
            contexts, back = np.unique(keys // SYMBOLS, return_inverse=True)
            below = self.counts[-1][_at(self.grams[-1], keys % SYMBOLS**order)[0]] if order else np.zeros(len(keys))
            stats = np.stack([np.bincount(back, x, len(contexts)) for x in (counts, np.ones(len(keys)), below)], axis=1)
            for held, x in ((self.grams, keys), (self.counts, counts), (self.contexts, contexts), (self.stats, stats)):
                held.append(x)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last symbol of each gram."""
        out, done = np.zeros(len(grams)), np.zeros(len(grams), dtype=bool)
        gone, gone_kinds = np.zeros(len(grams)), np.zeros(len(grams))  # what longer contexts exclude here
        for order in range(ORDER, -1, -1):
            key = grams % SYMBOLS ** (order + 1)
            at, known = _at(self.contexts[order], key // SYMBOLS)
            if not known.any():
                continue
            total, kinds, below = np.where(known[:, None], self.stats[order][at], 0.0).T
            left, left_kinds = total - gone, kinds - gone_kinds
            base = np.log2(np.maximum(left + left_kinds, 1))
            place, seen = _at(self.grams[order], key)
            here = ~done & seen & known
            out[here] += (base - np.log2(self.counts[order][place]))[here]
            done |= here
            escape = ~done & known & (left_kinds > 0)
            out[escape] += (base - np.log2(np.maximum(left_kinds, 1)))[escape]
            gone, gone_kinds = np.where(known, below, gone), np.where(known, kinds, gone_kinds)
        out[~done] += np.log2(np.maximum(256 - gone_kinds[~done], 1))
        return out


class Model:
    """Frozen trees of all languages."""

    def __init__(self, lang: list[str], gram: np.ndarray, n: np.ndarray):
        names = np.array(lang, dtype=object)
        self.langs = sorted(set(lang))
        self.trees = [Tree(gram[names == x], n[names == x].astype(float)) for x in self.langs]

    def coder(self) -> Coder:
        return Coder(self)


class Coder:
    """Code lengths of texts, with a table of the costs of grams met before."""

    def __init__(self, model: Model):
        self.trees = model.trees
        wide = max(1, len(self.trees))
        self.shift = 64 - max(8, int(np.log2(max(1, KEPT // wide))))
        self.held = np.full(1 << (64 - self.shift), -1, dtype=np.int64)
        self.costs = np.zeros((len(self.held), wide), dtype=np.float32)
        self.chunk = max(1 << 12, CHUNK // wide)

    def _costs(self, grams: np.ndarray) -> np.ndarray:
        slot = ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)
        hit = self.held[slot] == grams
        out = self.costs[slot]
        if not hit.all():
            new, back = np.unique(grams[~hit], return_inverse=True)
            found = np.stack([t.bits(new) for t in self.trees], axis=1).astype(np.float32)
            out[~hit] = found[back]
            first = np.zeros(len(new), np.int64)
            first[back] = slot[~hit]
            self.held[first], self.costs[first] = new, found
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text (a row) in each language (a column)."""
        out = np.zeros((len(texts), len(self.trees)))
        if not self.trees:
            return out
        rows, parts, size = [], [], 0

        def settle():
            if parts:
                costs = self._costs(np.concatenate(parts))
                starts = np.cumsum([0, *[len(p) for p in parts[:-1]]])
                np.add.at(out, rows, np.add.reduceat(costs, starts, axis=0, dtype=np.float64))

        for row, text in enumerate(texts):
            for piece in _pieces(text, self.chunk):
                rows.append(row)
                parts.append(piece)
                size += len(piece)
                if size >= self.chunk:
                    settle()
                    rows, parts, size = [], [], 0
        settle()
        return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", most: int | None = None) -> Model:
    """Trees of every language that a labelled text has.  Null labels and texts teach nothing.

    All labelled text is counted, or with ``most`` a sample of about so many bytes a language, which
    bounds the trees on text of any size and kind.
    """
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    texts = labelled if most is None else sample(labelled, text, lang, most)
    counts = count_contexts(texts, text, lang).toArrow()
    return Model(counts.column("lang").to_pylist(), counts.column("gram").to_numpy(), counts.column("n").to_numpy())


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row, ``lang_pred`` and ``score``, its posterior probability.

    ``und`` with score 0 for null texts, for texts without a letter, and for a model without
    languages.  Ties go to the first language by code point.  Whole texts are scored, ill-formed ones byte by byte.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(*keep, F.col(text).alias("__text"))
    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    names = [*keep, "lang_pred", "score"]

    def run(batches):
        coder = model.coder()
        for batch in batches:
            texts = utf8(batch.column(batch.num_columns - 1))
            lettered = [LETTER.search(readable(t)) is not None for t in texts]
            bits = coder.bits([t if ok else b"" for t, ok in zip(texts, lettered, strict=True)])
            if model.langs:
                best = bits.argmin(axis=1)
                odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                found = [(model.langs[b], float(1 / o)) if ok else (UND, 0.0) for b, o, ok in zip(best, odds, lettered, strict=True)]
            else:
                found = [(UND, 0.0)] * len(texts)
            arrays = [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return slim.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that training must not see: crc32 of the id as text, modulo 4, is 2 (null ids never)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
