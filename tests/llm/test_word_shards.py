"""The shards of the word model: packed counts, requests in rounds, and what is left on disk."""

import numpy as np
from pyspark.sql import functions as F

from hitloom.llm import quality_lm
from hitloom.llm.common import shuffles_removed


def texts(documents):
    draw = np.random.default_rng(5)
    rows = [" ".join(f"w{int(i)}" for i in draw.zipf(1.3, 400) % 5_000) for _ in range(60)]
    return documents(*rows, "", None, rows[0])


def shuffled(spark):
    """Bytes of shuffle that the session holds on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle"))


def test_rounds_and_shards_agree_with_one(spark, documents, monkeypatch):
    docs, ids = texts(documents), spark.range(0, 60, 2).toDF("doc_id")
    rows = lambda: [tuple(r) for r in quality_lm.classify(docs, ids).orderBy("doc_id").collect()]
    whole = rows()
    for name, value in (("ROUND_BYTES", 0), ("ROUNDS", 3), ("SHARD", 5_000), ("BUCKET", 9_000), ("ASKED_ROWS", 700), ("GRAM_ROWS", 90)):
        monkeypatch.setattr(quality_lm, name, value)
    for row, other in zip(rows(), whole, strict=True):
        assert row[:3] == other[:3] and row[5] == other[5]
        assert np.allclose([x or 0.0 for x in row[3:5]], [x or 0.0 for x in other[3:5]], rtol=1e-9)


def test_shuffles_go_with_their_query(spark, tmp_path):
    rows, before = spark.range(50_000).repartition(4, "id"), shuffled(spark)
    with shuffles_removed(spark):
        rows.write.parquet(str(tmp_path / "within"))
    assert shuffled(spark) <= before
    rows.write.parquet(str(tmp_path / "after"))
    assert shuffled(spark) > before


def test_pairs_take_few_bytes(spark, documents):
    docs = texts(documents).where("text <> ''")
    packed = quality_lm.packed_pairs(docs, "text", 4).persist()
    pairs = quality_lm.pair_rows(packed)
    want = docs.select(F.filter(F.split("text", " "), lambda w: w != "").alias("w")).select(F.explode(F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), "w").alias("a"), F.col("w").alias("b"))).alias("p"))
    want = sorted(r.n for r in want.where("p.b IS NOT NULL").groupBy("p").agg(F.count("*").alias("n")).collect())
    assert sorted(r.n for r in pairs.collect()) == want
    assert packed.agg(F.sum(F.octet_length("data"))).first()[0] < 14 * len(want)  # 32 as rows
    packed.unpersist()


def test_squeezed_columns_come_back():
    for n in (0, 1, 1_000):
        draw = np.random.default_rng(n)
        columns = [np.sort(draw.integers(0, 2**64, n, np.uint64)), draw.integers(-9, 9, n), draw.random(n)]
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(columns, quality_lm.spread(quality_lm.squeeze(*columns), np.uint64, np.int64, np.float64), strict=True))
