"""Line removal beside a slow count of whole lines, and the perfect hash by itself."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.llm import lines


def slow(texts, least):
    """(n_lines, n_dropped, kept) of each text, by counting keys as they are."""
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    split = [(t or "").split("\n") for t in texts]
    found = Counter(k for x in split for k in {key(y) for y in x})
    gone = {k for k, n in found.items() if k and n >= least}
    kept = [[y for y in x if key(y) not in gone] for x in split]
    return [(len(x), len(x) - len(y), "\n".join(y)) for x, y in zip(split, kept)]


TEXTS = (
    ["Menu\nHome \n\n own line %d\n\tMENU\x0b\nÄ\nend" % i for i in range(7)]
    + ["menu\nä\nÄ\nmenu\nhome\nMenu.", None, "", "\n", "   \n \t ", "menu", "own line 3\n\nOwn Line 3"]
    + ["x" * 100_000 + "\nmenu\n" + "\n".join(f"line {i % 900}" for i in range(3000))]
    + ["\n".join(f"LINE {i}" for i in range(900))] * 5
)


def found(docs, **more):
    rows = lines.drop_frequent_lines(docs, **more).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("least", [1, 2, 6, 9])
def test_at_hand_and_dealt_index_agree_with_slow_count(documents, least):
    docs = documents(*TEXTS).repartition(5)
    want = sorted(((i, *x) for i, x in enumerate(slow(TEXTS, least))), key=repr)
    assert found(docs, least=least) == want
    assert found(docs, least=least, at_hand=0, shard=64) == want


def test_shard_that_many_ask_is_copied(documents, monkeypatch):
    docs = documents(*TEXTS)
    monkeypatch.setattr(lines, "ASKED", 100)
    assert found(docs, least=6, at_hand=0, shard=1 << 16) == sorted(((i, *x) for i, x in enumerate(slow(TEXTS, 6))), key=repr)


def test_hard_rows(hard, spark):
    want = Counter(x for x in slow([r.text for r in hard.collect()], 3))
    for more in ({}, {"at_hand": 0}):
        assert Counter(x[1:] for x in found(hard, least=3, **more)) == want
        assert found(hard.limit(0), least=3, **more) == []
    assert want[(1, 1, "")] == 3  # two rows of one id, and a third with their text


def test_ill_formed_bytes_are_kept_apart(spark):
    rows = spark.createDataFrame([(i, bytes(t)) for i, t in enumerate([b"a\xff\nb", b"A\xff\nc", b"a\xfe\nd"])], "doc_id long, raw binary")
    docs = rows.select("doc_id", F.expr("cast(raw as string)").alias("text"))
    for more in ({}, {"at_hand": 0}):
        assert [x[1:] for x in found(docs, least=2, **more)] == [(2, 1, "b"), (2, 1, "c"), (2, 0, "a�\nd")]


@pytest.mark.parametrize("n", [0, 1, 2, 65, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    words = np.unique(rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64), axis=0)
    made = lines.PerfectHash.build(words)
    assert sorted(made.places(words)) == list(range(len(words)))  # minimal, and perfect
    numbers = rng.integers(1, 1 << 40, len(words))
    shard = lines.Shard(*lines.Shard.pack(words, numbers))
    assert (shard.counts(words) == np.minimum(numbers, (1 << 32) - 1)).all()
    others = rng.integers(1 << 63, (1 << 64) - 1, (1000, 2), dtype=np.uint64)
    assert not shard.counts(others).any()
    assert sum(b.nbytes for b in made.levels) <= n * 0.6 + 200  # under five bits a hash


def test_hashes_that_never_part_are_listed(monkeypatch):
    monkeypatch.setattr(lines, "LEVELS", 1)
    words = np.array([[random.Random(i).getrandbits(63), i] for i in range(200)], np.uint64)
    made = lines.PerfectHash.build(words)
    assert len(made.rest) and sorted(made.places(words)) == list(range(200))


def test_index_holds_every_count(documents):
    index, total, shards = lines.line_index(documents(*TEXTS), shard=100)
    parts = {r.shard: lines.Shard(r.levels, r.rest, r.fingerprints, r.counts) for r in index.collect()}
    want = Counter(k for t in TEXTS for k in {h for h in lines.line_hashes((t or "").encode().split(b"\n")) if h})
    assert total == len(want) and shards == -(-total // 100)
    words = lines.as_words(list(want))
    place = lines.shard_of(words, shards)
    assert [int(parts[int(s)].counts(w[None])[0]) for s, w in zip(place, words)] == list(want.values())
