"""Alignment of the tokens of two tokenizers over the same texts, and how often ids go together.

Both tokenizers cut the same bytes.  The intervals of all their tokens are sorted by start, a running
maximum of the ends tells where no token reaches over, and there a group ends.  Within a group the
tokens of one side expand into those of the other that they overlap; pairs that end at one byte are links.
Whole batches of texts are one line of bytes, so this is a few array operations.

A corpus-wide count of each linked pair of ids follows, and each document learns how well its links
agree with these counts.  There are at most as many pairs as ids times ids, however large the corpus is.
The commonest pairs, a bounded number, go to all tasks; rarer ones meet their documents by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitloom.llm.common import bounded_batches, materialize, utf8

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of ids that every task may hold: 13 bytes each.
BROADCAST_PAIRS = 1 << 20
#: Bytes of text that are aligned at once; a longer text is cut between words, where both tokenizers cut.
PIECE = 1 << 20
#: Words whose pieces a task remembers.
CACHE = 1 << 17

# The pattern that splits text before the merges of the byte-level tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = "▁"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 characters for
    themselves, the other bytes in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """A byte-level BPE vocabulary file, whose ids must follow the order of its merges."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"] for t in model["added_tokens"]}
        letter, vocabulary = byte_letters(), model["model"]["vocab"]
        ranks = {bytes(letter[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["model"]["merges"]]
        if any(b <= a for a, b in zip(made, made[1:])):
            raise ValueError(f"the ids of {path} do not follow its merges")
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self._coder = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special tokens in it are plain text."""
        return self._coder.encode_ordinary(text)


class Pieces:
    """A piece model that puts a space before each text.  Where no piece has a blank after another
    letter, nothing joins over the end of a word, so words are looked up in what the task remembers."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.tokens = [bytes([int(n[3:5], 16)]) if self._model.is_byte(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(names)]
        self._by_words = not any(re.search(f"[^{BLANK}]{BLANK}", n) for n in names)
        # A blank at the end of a text: the model gives an empty text nothing, not even its own space.
        self._last = [self._model.piece_to_id(BLANK)]
        self._known: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        """Ids of a text that starts with a space, which is the one that the model would add."""
        if not self._by_words:
            return self._model.encode(text[1:])
        out, known = [], self._known
        for word in re.findall(" +[^ ]*", text):
            ids = known.get(word)
            if ids is None:
                if len(known) >= CACHE:
                    known.clear()
                ids = known[word] = self._model.encode(word[1:]) if word != " " else self._last
            out += ids
        return out


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of tokens whose intervals overlap, in order; each side's tokens follow one another."""
    low = np.searchsorted(end_b, start_a, "right")
    n = np.maximum(np.searchsorted(start_b, end_a, "left") - low, 0)
    i = np.repeat(np.arange(len(start_a)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return i, j


def coalesce(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The group of each interval, numbered from 0 by place: groups break where a start reaches the
    highest end so far."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group


def segments(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut before a space between two words."""
    while len(text) > most:
        cut = most
        while cut > 0 and not (text[cut] == " " and not text[cut - 1].isspace() and not text[cut + 1 : cut + 2].isspace()):
            cut -= 1
        if not cut:
            found = re.compile(r"(?<=\S) (?=\S)").search(text, most)
            if not found:
                break
            cut = found.start()
        yield text[:cut]
        text = text[cut:]
    yield text


class Aligner:
    """Both tokenizers and the tables made of them."""

    def __init__(self, folder: str):
        self.a, self.b = ByteBPE(f"{folder}/{BYTE_BPE}"), Pieces(f"{folder}/{PIECES}")
        self.sizes = [np.array([len(t) for t in x.tokens], np.int64) for x in (self.a, self.b)]
        # Each id with what may follow it: a comma, the bar between the sides, the end of a group.
        ids = [str(i) for x in (self.a, self.b) for i in range(len(x.tokens))]
        self.printed = [i + mark for i in ids for mark in ",|;"]

    def encoded(self, text: bytes) -> list[tuple[bytes, list[int], list[int]]] | None:
        """(bytes, A's ids, B's ids) of the segments of a text; None if a side does not give its bytes again."""
        try:
            words = " " + text.decode()
        except UnicodeDecodeError:
            return None
        out = []
        for part in segments(words):
            a, b, whole = self.a.encode(part), self.b.encode(part), part.encode()
            if any(b"".join(map(x.tokens.__getitem__, ids)) != whole for x, ids in ((self.a, a), (self.b, b))):
                return None
            out.append((whole, a, b))
        return out

    def align(self, parts: list[tuple[bytes, list[int], list[int]]]) -> tuple[list[str], np.ndarray, list[np.ndarray]]:
        """Of each segment its groups as text, how many they are, and its links as codes: A's id in
        the upper 32 bits, B's in the lower."""
        count = [np.array([len(p[s]) for p in parts], np.int64) for s in (1, 2)]
        ids = [np.fromiter((i for p in parts for i in p[s]), np.int64, count[s - 1].sum()) for s in (1, 2)]
        ends = [np.cumsum(self.sizes[s][ids[s]]) for s in (0, 1)]
        starts = [ends[s] - self.sizes[s][ids[s]] for s in (0, 1)]
        n_a, n_b = len(ids[0]), len(ids[1])
        group = coalesce(np.concatenate(starts), np.concatenate(ends), np.repeat([0, 1], [n_a, n_b]))
        of_a, of_b = group[:n_a], group[n_a:]
        total = int(group.max()) + 1 if len(group) else 0
        # Places in the printed form: the tokens of a group, A's before B's.
        below_a, below_b = np.bincount(of_a, minlength=total).cumsum(), np.bincount(of_b, minlength=total).cumsum()
        printed = np.empty(n_a + n_b, np.int64)
        last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        last_a[below_a - 1], last_b[below_b - 1] = 1, 2
        printed[np.arange(n_a) + np.concatenate(([0], below_b))[of_a]] = 3 * ids[0] + last_a
        printed[np.arange(n_b) + below_a[of_b]] = 3 * (len(self.sizes[0]) + ids[1]) + last_b
        i, j = overlaps(starts[0], ends[0], starts[1], ends[1])
        together = ends[0][i] == ends[1][j]
        i, j = i[together], j[together]
        codes = (ids[0][i] << 32) + ids[1][j]
        names, places = list(map(self.printed.__getitem__, printed.tolist())), np.concatenate(([0], (count[0] + count[1]).cumsum()))
        bounds = np.cumsum(np.array([len(p[0]) for p in parts], np.int64))
        groups = np.diff(np.searchsorted(ends[0][below_a - 1], bounds, "right"), prepend=0)
        cuts = np.searchsorted(ends[0][i], bounds, "right")
        return ["".join(names[x:y])[:-1] for x, y in zip(places, places[1:])], groups, np.split(codes, cuts[:-1])


def _aligned(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    aligner = Aligner(folder)
    for batch in batches:
        texts = utf8(batch.column(1))
        rows = [[0, 0, 0, None, []] for _ in texts]  # n_a, n_b, n_groups, the hash of the groups, links
        waiting: list = []

        def flush(rows=rows, waiting=waiting) -> None:
            printed, groups, links = aligner.align([p for _, p in waiting])
            for (row, (_, a, b)), text, n, codes in zip(waiting, printed, groups, links):
                x = rows[row]
                x[0], x[1], x[2] = x[0] + len(a), x[1] + len(b), x[2] + int(n)
                if x[3] is None:
                    x[3] = hashlib.sha256(text.encode())
                else:
                    x[3].update(b";" + text.encode())
                x[4].append(codes)
            waiting.clear()

        size = 0
        for row, text in enumerate(texts):
            for part in (aligner.encoded(text) if text else None) or []:
                waiting.append((row, part))
                size += len(part[0])
                if size >= PIECE:
                    flush()
                    size = 0
        if waiting:
            flush()
        links = [np.concatenate(x[4]) if x[4] else np.zeros(0, np.int64) for x in rows]
        sizes = [len(x) for x in links]
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        flat = np.concatenate(links) if links else np.zeros(0, np.int64)
        counts = [pa.array([x[s] for x in rows], pa.int64()) for s in (0, 1, 2)]
        digest = pa.array([x[3].hexdigest() if x[3] else "" for x in rows], pa.string())
        columns = [batch.column(0), *counts, pa.array(sizes, pa.int64()), digest, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])


def align_tokens(docs: DataFrame, folder: str = TOKENIZERS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, stored in the shared folder: key, id, n_a, n_b, n_groups, n_links,
    groups_sha256, links.

    Texts that are null, empty, ill-formed, or that a tokenizer does not give again byte for byte have
    no tokens.  A link is a code: A's id in the upper 32 bits, B's in the lower.  Rows are
    never merged, whatever their ids.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(text).alias("text"), F.col(doc_id).alias("id"))
    kind = rows.schema["id"].dataType.simpleString()
    named = rows.select(F.struct("key", "id").alias("key"), "text")
    schema = f"key struct<key: bigint, id: {kind}>, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<bigint>"
    found = named.mapInArrow(lambda batches: _aligned(batches, folder), schema)
    return materialize(found.select("key.*", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"), "alignments")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(code, a, b, n, best): how many links hold each pair, and whether none of its B id is held by more.
    Stored in the shared folder; an id of B has at most as many pairs as A has ids."""
    sums = aligned.select("links").mapInArrow(_counted, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    a, b = F.shiftright("code", 32), F.col("code").bitwiseAND((1 << 32) - 1)
    pairs = sums.select("code", a.alias("a"), b.alias("b"), "n")
    most = F.max("n").over(Window.partitionBy("b"))
    return materialize(pairs.withColumn("best", F.col("n") == most), "pairs")


def common_from(pairs: DataFrame, most: int) -> int:
    """The lowest power of two that at most ``most`` pairs reach with their counts."""
    sizes = {r.e: r.m for r in pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count("*").alias("m")).collect()}
    low, held = max(sizes, default=0) + 1, 0
    while low > 0 and held + sizes.get(low - 1, 0) <= most:
        low -= 1
        held += sizes.get(low, 0)
    return 1 << low


def _looked_up(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    codes, n, best = table.value
    for batch in batches:
        links = batch.column(1)
        flat = links.flatten().to_numpy(zero_copy_only=False)
        place = np.minimum(np.searchsorted(codes, flat), max(len(codes) - 1, 0))
        known = codes[place] == flat if len(codes) else np.zeros(len(flat), bool)
        ends = np.concatenate(([0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False))))
        sums = []
        for values in (best, n):
            running = np.concatenate(([0], np.cumsum(np.where(known, values[place], 0) if len(codes) else np.zeros(len(flat), np.int64))))
            sums.append(pa.array(running[ends[1:]] - running[ends[:-1]], pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *sums], names=["key", "n_best", "count_sum"])


def _rest(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """(key, code, times) of the links that the table lacks."""
    codes = table.value[0]
    for batch in batches:
        links = batch.column(1)
        flat = links.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(links)), links.value_lengths().to_numpy(zero_copy_only=False))
        rest = ~np.isin(flat, codes)
        (row, flat), times = np.unique(np.stack((row[rest], flat[rest])), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(flat, pa.int64()), pa.array(times, pa.int64())], names=["key", "code", "times"])


def agreement(aligned: DataFrame, pairs: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """(key, n_best, count_sum): of each row of ``align_tokens``, how many links are the best of their B id,
    ties included, and the sum of the counts of its links.

    The commonest pairs, ``most`` at most, are looked up in each task; the rest, which are rare, are joined.
    """
    spark = aligned.sparkSession
    least = common_from(pairs, most)
    common = pairs.where(F.col("n") >= least).select("code", "n", F.col("best").cast("long").alias("best")).toArrow().sort_by("code")
    table = spark.sparkContext.broadcast(tuple(common.column(c).to_numpy() for c in ("code", "n", "best")))
    found = aligned.select("key", "links").mapInArrow(lambda batches: _looked_up(batches, table), "key bigint, n_best bigint, count_sum bigint")
    if not pairs.where(F.col("n") < least).head(1):
        return found
    rare = pairs.where(F.col("n") < least).select("code", "n", F.col("best").cast("long").alias("best"))
    held = aligned.select("key", "links").mapInArrow(lambda batches: _rest(batches, table), "key bigint, code bigint, times bigint")
    met = held.join(rare, "code").groupBy("key").agg(F.sum(F.col("best") * F.col("times")).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return found.unionByName(met).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
