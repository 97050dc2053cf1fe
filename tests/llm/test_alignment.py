"""Token alignment beside a slow one that walks over byte ends, with the tokenizers of the files themselves."""

import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hitloom.llm import alignment

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
FOLDER = alignment.TOKENIZERS


@pytest.fixture(scope="module")
def coders():
    a = tokenizers.Tokenizer.from_file(f"{FOLDER}/{alignment.BYTE_BPE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/{alignment.PIECES}")
    return a, b


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(FOLDER)


def slow(texts, coders):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    a, b = coders
    letters = alignment.byte_letters()
    bytes_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, count = [], Counter()
    for text in texts:
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        parts = [[bytes_a(i) for i in ids[0]], [bytes_b(i) for i in ids[1]]]
        if not text or any(b"".join(p) != b" " + text.encode() for p in parts):
            found.append(([], [], [], []))
            continue
        ends = [{}, {}]
        for side in (0, 1):
            at = 0
            for i, p in zip(ids[side], parts[side]):
                at += len(p)
                ends[side][at] = i
        cuts = sorted(ends[0].keys() & ends[1].keys())
        links = [(ends[0][c], ends[1][c]) for c in cuts]
        within = [defaultdict(list), defaultdict(list)]
        for s in (0, 1):
            for e, i in ends[s].items():
                within[s][bisect.bisect_left(cuts, e)].append(str(i))
        groups = ["|".join(",".join(within[s][n]) for s in (0, 1)) for n in range(len(cuts))]
        count.update(links)
        found.append((ids[0], ids[1], groups, links))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(len(x), len(y), len(g), len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for x, y, g, k in found]


TEXTS = [
    "The quick brown fox jumps over the lazy dog.",
    None,
    "",
    " ",
    "two  blanks   and\ttabs\n\nlines \r\n end ",
    "Straßenbahnhaltestelle naïve façade 12345 3.14 don't",
    "<|endoftext|> <s> </s> <unk> [INST]",
    "▁a word▁with its mark",
    "日本語のテキスト 🙂🙂 \U0001f468‍\U0001f469‍\U0001f467 ﬁ ½ é",
    "\x00\x01\x7f",
    "a" * 5000,
    "the the the the",
    "The quick brown fox jumps over the lazy dog.",
]


def agreed(docs, most=alignment.BROADCAST_PAIRS):
    aligned = alignment.align_tokens(docs)
    rows = aligned.join(alignment.agreement(aligned, alignment.pair_counts(aligned), most), "key")
    return rows.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()


@pytest.mark.parametrize("most", [0, 1, 20, 1 << 20])
def test_beside_slow(documents, coders, most):
    want = sorted((i, *x) for i, x in enumerate(slow(TEXTS, coders)))
    assert sorted(tuple(r) for r in agreed(documents(*TEXTS).repartition(3), most)) == want


def test_hard_rows(hard, coders):
    rows = hard.collect()
    want = sorted(((r.doc_id, *x) for r, x in zip(rows, slow([r.text for r in rows], coders))), key=repr)
    assert sorted((tuple(r) for r in agreed(hard)), key=repr) == want
    assert agreed(hard.limit(0)) == []


def test_ill_formed_texts_have_no_tokens(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(unhex('61ff62') AS string) AS text")
    assert [tuple(r)[1:] for r in agreed(docs)] == [(0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t.'▁aé日1"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=60))
def test_faster_coders_agree_with_the_files(text):
    a, b = _COLD
    mine = _ALIGNER
    assert mine.a.encode(" " + text) == a.encode(" " + text, add_special_tokens=False).ids
    assert mine.b.encode(" " + text) == b.encode(text)
    parts = list(alignment.segments(" " + text, 7))
    assert "".join(parts) == " " + text
    assert [i for p in parts for i in mine.a.encode(p)] == mine.a.encode(" " + text)
    assert [i for p in parts for i in mine.b.encode(p)] == mine.b.encode(" " + text)


@pytest.fixture(scope="module", autouse=True)
def _loaded(coders, aligner):
    global _COLD, _ALIGNER
    _COLD, _ALIGNER = coders, aligner


def test_long_text_in_segments(documents, coders, monkeypatch):
    text = " ".join(f"word{i % 77} and\n\n  more{i % 13}" for i in range(4000))
    want = slow([text, "short"], coders)
    monkeypatch.setattr(alignment, "PIECE", 500)
    monkeypatch.setattr(alignment.segments, "__defaults__", (500,))
    assert sorted(tuple(r)[1:] for r in agreed(documents(text, "short"))) == sorted(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=20), st.lists(st.integers(1, 4), max_size=20))
def test_overlaps_and_groups(a, b):
    b = [*b, sum(a) - sum(b)] if sum(a) > sum(b) else b
    a = [*a, sum(b) - sum(a)] if sum(b) > sum(a) else a
    ends = [np.cumsum(np.array(x, np.int64)) for x in (a, b)]
    starts = [e - np.array(x, np.int64) for e, x in zip(ends, (a, b))]
    i, j = alignment.overlaps(starts[0], ends[0], starts[1], ends[1])
    slow_pairs = [(x, y) for x in range(len(a)) for y in range(len(b)) if starts[0][x] < ends[1][y] and starts[1][y] < ends[0][x]]
    assert list(zip(i.tolist(), j.tolist())) == slow_pairs
    if a:
        group = alignment.coalesce(np.concatenate(starts), np.concatenate(ends), np.repeat([0, 1], [len(a), len(b)]))
        cuts = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        assert group.tolist() == [int(np.searchsorted(cuts, e, "left")) for e in np.concatenate(ends)]
