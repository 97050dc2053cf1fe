"""Centroid clustering in integers, by progressive search over Walsh-Hadamard coefficients.

The transform keeps squared distances but for a factor, and its first coefficients, in order of sign changes, tell
most.  Vectors are transformed once.  A search adds up squared differences of coefficients block by block;
after the first block the likeliest centroid is worked out whole, and from then on a centroid whose
partial sum exceeds the best whole one is strictly worse and goes.  Those that stay get all coefficients, so
distances are exact, and ties go to the smaller number.

Each round sends the centroids, a few rows, to all tasks and brings back sums, a row for each centroid
and coefficient that tasks have added up before any shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.llm.common import bounded_batches, materialize

WIDTH, SCALE = 64, 1024
#: Coefficients that a search adds before it drops centroids again.
BLOCKS = (8, 8, 16, 32)
#: Components below this keep every sum of a search within 63 bits; larger ones are counted in Python's integers.
SMALL = 1 << 20
#: Components from here on raise: a sum over all rows could pass 38 digits.
LARGEST = 1 << 62
LONG = (1 << 63) - 1


def by_sign_changes(width: int = WIDTH) -> np.ndarray:
    """The rows of the natural-order transform in ascending order of their sign changes."""
    rows = hadamard(np.eye(width, dtype=np.int64))
    return np.argsort((np.diff(rows, axis=1) != 0).sum(axis=1), kind="stable")


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, in natural order, exact in whatever integers these are."""
    out, half, width = rows.copy(), 1, rows.shape[1]
    while half < width:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(out), width)
        half *= 2
    return out


def nearest(rows: np.ndarray, centroids: np.ndarray, blocks: tuple[int, ...] = BLOCKS) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance, differences taken) of the centroid nearest to each row, all given by
    their coefficients, coarse ones first.  The distance is that of the vectors, 1/width of the coefficients'."""
    n, k = len(rows), len(centroids)
    partial = np.zeros((n, k), rows.dtype)
    edges = np.cumsum((0, *blocks))

    def add(at: np.ndarray, of: np.ndarray, lo: int, hi: int) -> np.ndarray:
        gap = rows[at, lo:hi] - centroids[of, lo:hi]
        return (gap * gap).sum(axis=1)

    for c in range(k):
        partial[:, c] = add(np.arange(n), np.full(n, c), 0, edges[1])
    likely = partial.argmin(axis=1) if rows.dtype != object else np.array([min(range(k), key=p.__getitem__) for p in partial], np.int64)
    every = np.arange(n)
    best = partial[every, likely] + add(every, likely, edges[1], edges[-1])
    taken = n * k * blocks[0] + n * (edges[-1] - edges[1])
    at, of = np.nonzero((partial <= best[:, None]).astype(bool) & (np.arange(k) != likely[:, None]))
    sums = partial[at, of]
    for lo, hi in zip(edges[1:], edges[2:]):
        sums = sums + add(at, of, lo, hi)
        taken += len(at) * (hi - lo)
        stay = (sums <= best[at]).astype(bool)
        at, of, sums = at[stay], of[stay], sums[stay]
        if hi < edges[-1]:
            continue
        # All that is left is whole: the least of it and of the likely one, ties to the smaller number.
        number = likely.copy()
        for row, c, s in zip(at, of, sums):
            if s < best[row] or s == best[row] and c < number[row]:
                best[row], number[row] = s, c
    return number, best // rows.shape[1], int(taken)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _fit(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in integers that hold every sum of a search."""
    peak = max((int(abs(x).max()) for x in (rows, centroids) if x.size), default=0)
    kind = np.int64 if peak < SMALL * WIDTH else object
    return rows.astype(kind), centroids.astype(kind)


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = by_sign_changes()
    for batch in batches:
        rows = _matrix(batch.column(1))
        flat = hadamard(rows)[:, order].ravel()
        offsets = pa.array(np.arange(0, len(flat) + 1, WIDTH, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["vec_id", "c"])


def _sums(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """(cluster, i, n, total): sums of the rows nearest to each centroid, of all batches of the task."""
    k = len(centroids)
    total, count = np.zeros((k, WIDTH), object), [0] * k
    for batch in batches:
        if not len(batch):
            continue
        rows, middle = _fit(_matrix(batch.column(0)), np.array(centroids, object))
        number = nearest(rows, middle)[0]
        for c in np.unique(number):
            mine = rows[number == c]
            total[c] += mine.astype(object).sum(axis=0) if mine.dtype == object else mine.sum(axis=0).astype(object)
            count[c] += len(mine)
    cells = [(c, i, count[c], Decimal(int(total[c, i]))) for c in range(k) if count[c] for i in range(WIDTH)]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in cells], t) for j, t in enumerate(kinds)], names=["cluster", "i", "n", "total"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        rows, middle = _fit(_matrix(batch.column(1)), np.array(centroids, object))
        number, distance, _ = nearest(rows, middle)
        if any(int(d) > LONG for d in distance):
            raise OverflowError("a squared distance is beyond the range of long; scale the vectors down")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(distance.astype(np.int64))], names=["vec_id", "cluster", "distance"])


def prepared(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors of 64 components, none null or non-finite, times ``scale`` and rounded down."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = lambda x: F.lit(scale) * x.cast("double")
    beyond = F.raise_error(F.lit("a component is too large; scale the vectors down")).cast("long")
    ints = F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < float(LARGEST // WIDTH), F.floor(scaled(x))).otherwise(beyond))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) == WIDTH) & sound).select(F.col(vec_id).alias("vec_id"), ints.alias("v"))


def seed_order(vec_id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")), 256)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector that takes part.

    Centroids start as the ``k`` vectors with the smallest hashes of their ids (those without an id come
    last, equal ids by their components; fewer vectors give fewer centroids) and become the means of
    their vectors, rounded down, ``rounds`` times; one without vectors stays.  Rows that repeat count as often as they
    stand there.  An empty table gives no rows; distances beyond the range of long raise.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = prepared(vectors, vec_id, vector)
    first = rows.select("v", seed_order(F.col("vec_id"), seed).alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    kind = rows.schema["vec_id"].dataType.simpleString()
    stored = materialize(rows.mapInArrow(_transformed, f"vec_id {kind}, c array<bigint>"), "coefficients")
    order = by_sign_changes()
    means = np.array([r.v for r in first], object).reshape(len(first), WIDTH)
    found = spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint")
    if len(first):
        for _ in range(rounds):
            middle = hadamard(means)[:, order].tolist()
            sums = stored.select("c").mapInArrow(lambda b, m=middle: _sums(b, m), "cluster int, i int, n bigint, total decimal(38,0)")
            new = np.zeros((len(first), WIDTH), object)
            count = [0] * len(first)
            for r in sums.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # k times 64 rows
                new[r.cluster, order[r.i]], count[r.cluster] = int(r.total), r.n
            back = hadamard(new)
            means = np.array([[int(x) // WIDTH // n for x in b] if n else list(m) for b, n, m in zip(back, count, means)], object)
        middle = hadamard(means)[:, order].tolist()
        found = stored.mapInArrow(lambda b: _assigned(b, middle), f"vec_id {kind}, cluster int, distance bigint")
    found = materialize(found, "assigned")
    prints = [(c, hashlib.sha256(",".join(str(int(x)) for x in m).encode()).hexdigest()) for c, m in enumerate(means)]
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    table = spark.createDataFrame([(c, sums.get(c), sum(sums.values()), h) for c, h in prints], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
