import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.llm import topk


def brute(rows, k, asks):
    ok = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i, v in ok:
        if asks(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in ok if j != i and len(w) == len(v))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    return out


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 3 == 0, k).collect()}


def test_against_all_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "BLOCK", 10)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 3 == 0)


def test_ties_repeats_and_gaps(spark):
    same = [1.0, 0.0]
    rows = [(i, same) for i in range(9)] + [(3, same), (10, None), (11, [1.0, None]), (12, [float("nan"), 1.0]), (15, [float("inf"), 1.0]), (None, same), (18, [0.0, 0.0]), (21, [1.0])]
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 3 == 0)
    assert run(spark, []) == set() and run(spark, [(0, same)]) == set()
    assert run(spark, [(0, []), (1, []), (2, same)]) == {(0, 1, 1, 0)}


def test_large_components_stay_exact(spark):
    rows = [(0, [3.0e6, 1.0]), (1, [3.0e6, 1.0]), (2, [3.0e6, 2.0]), (3, [-3.0e6, 5.0])]
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 3 == 0)


def test_components_of_any_size_use_the_same_search(spark):
    rows = [(i, [float(1e6 + 7 * i), float((i * 37) % 11)]) for i in range(40)]
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 3 == 0)
    with pytest.raises(Exception, match="beyond the range of long"):
        run(spark, [(0, [3e18, 1.0]), (1, [3e18, 1.0])])
    with pytest.raises(Exception, match="beyond the range of long"):
        run(spark, [(0, [3e12, 1.0]), (1, [3e12, 1.0])])


@pytest.mark.parametrize("k", [1, 7])
def test_stopping_early_loses_nothing(k):
    rng = np.random.default_rng(4)
    vectors = np.floor(rng.normal(size=(600, 3)) * 50)
    vectors[:40] *= 20  # a few long vectors let the bound stop the search
    lists = topk.Lists(vectors)
    for query in np.floor(rng.normal(size=(20, 3)) * 50):
        rows, scores = lists.search(query, k, np.array([0]))
        want = sorted((-s, i) for i, s in enumerate(vectors @ query) if i)[:k]
        assert [(-s, i) for i, s in zip(rows, scores, strict=True)] == want


def test_the_bound_does_stop(monkeypatch):
    seen = []
    monkeypatch.setattr(topk, "_scores", lambda rows, query: seen.append(len(rows)) or rows @ query)
    vectors = np.ones((4000, 2))
    vectors[:10] = 1000
    topk.Lists(vectors).search(np.array([1.0, 1.0]), 5, np.zeros(0, int))
    assert sum(seen) < 400
