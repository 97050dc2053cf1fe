import corpus_pipeline
from hitloom.llm import decontaminate, toxicity
from pyspark.sql import functions as F
from test_simhash import similar_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i == 0:
            labels = spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
            bad = {r.doc_id for r in toxicity.score_documents(docs, labels).where(F.col("score") >= toxicity.THRESHOLD).collect()}
            want = ids - bad
        elif i == 1:
            held = docs.orderBy("doc_id").collect()
            want = {held[g].doc_id for g in similar_groups([r.text for r in held])[0]}
        elif i == 2:
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            want = {r.doc_id for r in decontaminate.contamination(docs, bench).where("n_hit = 0").collect()}
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = [r.doc_id for r in docs.collect()]
        if i < 3:
            assert sorted(rows) == sorted(want), name
        if i < 4:
            assert docs.columns == columns
            n = len(rows)
    assert docs.count() == n and {"doc_id", "shard", "slot"} <= set(docs.columns)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]


def test_stages_take_hard_rows(spark, hard):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, hard, SF)
        assert name == "sharding" or out.columns == hard.columns
        stage(spark, hard.limit(0), SF).count()
        assert out.count() > 0
