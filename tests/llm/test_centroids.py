"""Clustering beside a slow one in Python's integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, c string, label int"


def slow(rows, k, rounds, seed):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    means = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for c in range(len(means)):
            group = [v for (_, v), n in zip(kept, mine) if n == c]
            if group:
                means[c] = [sum(x) // len(group) for x in zip(*group)]
    last = [near(v) for _, v in kept]
    by = {c: sum(d for d, n in last if n == c) for _, c in last}
    print_ = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((i, c, d, by[c], sum(by.values()), print_[c]) for (i, _), (d, c) in zip(kept, last)), key=repr)


def rows_of(n, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(0, scale, 64).astype(np.float32)], "x", "y", 0) for i in range(n)]


def got(spark, rows, **more):
    out = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), **more)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("n, k, rounds, scale", [(150, 8, 3, 1.0), (5, 8, 2, 1.0), (90, 3, 0, 0.01), (40, 4, 2, 1e4)])
def test_beside_slow(spark, n, k, rounds, scale):
    rows = rows_of(n, n, scale)
    assert got(spark, rows, k=k, rounds=rounds, seed=3) == slow(rows, k, rounds, 3)


def test_hard_rows(spark):
    base = rows_of(30)
    bad = [(90, None), (91, [1.0] * 63), (92, [1.0] * 63 + [None]), (93, [1.0] * 63 + [float("nan")]), (94, [1.0] * 63 + [float("-inf")]), (95, [])]
    same = [(i, [0.5] * 64, "x", None, None) for i in (40, 40, 41, None, None)]  # repeated rows, ties, no id
    rows = base + [(*b, None, None, None) for b in bad] + same
    assert got(spark, rows, k=6, rounds=4, seed=3) == slow(rows, 6, 4, 3)
    assert got(spark, same, k=4, rounds=2, seed=3) == slow(same, 4, 2, 3)  # all tie: the smallest number has them all
    assert got(spark, bad and [(*b, None, None, None) for b in bad], k=3) == []


def test_too_large(spark):
    far = [(1, [2.0**40] * 64, "", "", 0), (2, [-(2.0**40)] * 64, "", "", 0)]
    with pytest.raises(Exception, match="beyond the range"):
        got(spark, far, k=1, rounds=0)
    with pytest.raises(Exception, match="too large"):
        got(spark, [(1, [1e38] * 64, "", "", 0)], k=1)


def test_transform_is_exact_and_search_drops_centroids():
    rng = np.random.default_rng(5)
    middle = rng.integers(-400, 400, (8, 64)) + np.linspace(-900, 900, 8).astype(np.int64)[:, None]
    rows = middle[rng.integers(0, 8, 500)] + rng.integers(-90, 90, (500, 64))
    order = centroids.by_sign_changes()
    changes = (np.diff(centroids.hadamard(np.eye(64, dtype=np.int64))[order], axis=1) != 0).sum(axis=1)
    assert changes.tolist() == list(range(64))
    assert (centroids.hadamard(centroids.hadamard(rows)) == 64 * rows).all()
    number, distance, taken = centroids.nearest(centroids.hadamard(rows)[:, order], centroids.hadamard(middle)[:, order])
    whole = ((rows[:, None] - middle[None]) ** 2).sum(axis=2)
    assert (number == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
    assert taken < 0.5 * whole.size * 64


def test_ties_go_to_the_smaller_number():
    rows = np.zeros((3, 64), np.int64)
    middle = np.stack([np.full(64, 3), np.full(64, -2), np.full(64, 2), np.full(64, -2)]).astype(np.int64)
    number, distance, _ = centroids.nearest(centroids.hadamard(rows), centroids.hadamard(middle))
    assert number.tolist() == [1, 1, 1] and distance.tolist() == [256] * 3
