"""The quality model knows the order of words, not just their spelling."""

import random

import numpy as np
from pyspark.sql import functions as F

from hitloom.llm import quality_lm

# All words begin and end alike, so byte trigrams do not see which ones are neighbours.
WORDS = [f"st{a}{b}en" for a in "bcdfgh" for b in "aeiou"]


def prose(rng):
    return " ".join(" ".join(WORDS[(i + k) % 30] for k in range(15)) for i in (rng.randrange(30) for _ in range(6)))


def test_word_salad_is_not_kept(spark, documents):
    rng = random.Random(3)
    good = [prose(rng) for _ in range(120)]
    salad = [" ".join(rng.sample(w := prose(rng).split(), len(w))) for _ in range(20)]
    ids = spark.range(100).toDF("doc_id")
    rows = {r.doc_id: r.keep for r in quality_lm.classify(documents(*good, *salad), ids).collect()}
    assert sum(rows[i] for i in range(100, 120)) >= 18
    assert not any(rows[i] for i in range(120, 140))


def test_own_counts_are_left_out(spark, documents):
    """A trusted text scored without its own counts has the perplexity that a model of the others gives it."""
    texts = ["a b c a b d", "a b c e f", "e f a b c c", "b d e a b"]
    docs = documents(*texts).withColumn("own", F.col("doc_id") == 0)
    byte = quality_lm.train(docs)
    every, others = quality_lm.WordModel(docs, "text"), quality_lm.WordModel(docs.where("NOT own"), "text")
    others.d1, others.d2 = every.d1, every.d2
    # The discounts are those of all texts, so the weights of the others are taken anew.
    pairs = quality_lm.count_pairs(docs.where("NOT own"), "text")
    cuts = pairs.groupBy(F.col("before").alias("key")).agg(F.sum(quality_lm._cut(F.col("n"), every.d2)).alias("c"))
    others.stats = others.stats.join(cuts, "key", "left").select("key", "n", "total", F.when(F.col("total").isNotNull(), F.col("c")).alias("cuts"))
    others.cuts = float(others.stats.join(pairs.select("key"), "key", "left_anti").where("n > 0").agg(F.sum(quality_lm._cut(F.col("n"), every.d1))).first()[0])
    score = lambda m, own: quality_lm.word_perplexity(docs.withColumn("own", F.lit(own)), byte, m, "text", ("doc_id",), "own").where("doc_id = 0").first().perplexity
    assert np.isclose(score(every, True), score(others, False))
