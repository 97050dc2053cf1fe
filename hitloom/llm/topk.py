"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into shards of bounded size by a hash, queries into blocks; each cell
(shard, block) is one group.  A cell sorts its vectors once per dimension.  A query reads
the lists from the end that favours it, scores what it meets, and stops as soon as the
best score that an unread vector could have is below its kth score.  The k best of each
shard then meet in a ranking per query.  Everything is in integers, so no rounding decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.llm.common import materialize

#: Vectors of a shard and queries of a block.
SHARD, BLOCK = 2048, 1024
#: Entries that the first round reads from each list; each round doubles the depth.
FIRST_DEPTH = 16
LONG = (-(1 << 63), (1 << 63) - 1)


def _scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return rows @ query


class Lists:
    """The sorted lists of a shard: ids ascending, so that row order breaks ties."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, order, axis=0)
        self.order = order.astype(np.int32)

    def search(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best, ties to the smaller row; never a row of ``skip``."""
        n = len(self.vectors)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, dtype=bool)
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.vectors.dtype)
        start, depth = 0, FIRST_DEPTH
        while True:
            stop = min(depth, n)
            met = np.zeros(n, dtype=bool)
            met[self.order[n - stop : n - start, up].ravel()] = True
            met[self.order[start:stop, down].ravel()] = True
            if stop == n:
                met[:] = True
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            fresh = fresh[~np.isin(fresh, skip)]
            rows = np.concatenate((rows, fresh))
            scores = np.concatenate((scores, _scores(self.vectors[fresh], query)))
            best = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[best], scores[best]
            if stop == n:
                return rows, scores
            bound = (self.values[n - stop, up] * query[up]).sum() + (self.values[stop - 1, down] * query[down]).sum()
            if len(rows) == k and bound < scores[-1]:
                return rows, scores
            start, depth = stop, 2 * depth


def _cell(table: pa.Table, k: int) -> pa.Table:
    width = table.column("width")[0].as_py()
    ids = table.column("id").to_numpy()
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vectors = flat.reshape(len(ids), width)
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    tags = table.column("tag").to_numpy()
    members = np.flatnonzero(~asks)
    members = members[np.argsort(ids[members], kind="stable")]
    peak = int(max(abs(int(flat.min())), abs(int(flat.max())))) if len(flat) else 0
    # Exact in doubles below 2^53; beyond that the same lists hold Python's integers.
    vectors = vectors.astype(np.float64 if peak * peak * max(width, 1) < 1 << 53 else object)
    out: list[tuple] = []
    if len(members):
        lists = Lists(vectors[members])
        for i in np.flatnonzero(asks):
            rows, scores = lists.search(vectors[i], k, np.flatnonzero(ids[members] == ids[i]))
            out += [(int(ids[i]), int(tags[i]), int(ids[members[r]]), int(s)) for r, s in zip(rows, scores, strict=True)]
    if any(not LONG[0] <= x[3] <= LONG[1] for x in out):
        raise OverflowError("a score is beyond the range of long; scale the vectors down")
    names = ("query_id", "tag", "vec_id", "score")
    return pa.table({n: pa.array([x[j] for x in out], pa.int64()) for j, n in enumerate(names)})


def top_k(vectors: DataFrame, asks: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The ``k`` best of all other rows for each row where ``asks`` holds, by the inner
    product of the components times ``scale``, rounded down: query_id, rank, vec_id, score.

    Rows without id and vectors that are null, or hold null or non-finite components, take
    no part.  Vectors of one length are compared.  Equal rows count once; rows that share
    the query's id are its own.  Ties go to the smaller id.  Fewer than k others give fewer rows.
    Components and scores beyond the range of long raise.
    """
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = lambda x: F.lit(scale) * x.cast("double")
    beyond = F.raise_error(F.lit("a component is beyond the range of long")).cast("long")
    ints = F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < float(1 << 62), F.floor(scaled(x))).otherwise(beyond))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & sound).select(
        F.col(vec_id).cast("long").alias("id"), ints.alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks")
    )
    rows = rows.distinct().withColumn("width", F.size("vector")).withColumn("tag", F.xxhash64("id", "vector"))
    rows = materialize(rows, "vectors")
    n, q = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-q // BLOCK))
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    members = rows.withColumn("asks", F.lit(False)).withColumn("shard", F.pmod("tag", F.lit(shards)).cast("int"))
    members = members.withColumn("block", spread(blocks))
    queries = rows.where("asks").withColumn("block", F.pmod("tag", F.lit(blocks)).cast("int"))
    queries = queries.withColumn("shard", spread(shards))
    found = members.unionByName(queries).groupBy("width", "shard", "block").applyInArrow(
        lambda table: _cell(table, k), "query_id long, tag long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
