"""Every labelled language is learnt, from all its text."""

import numpy as np

from hitloom.llm import language_id


def test_languages_of_copies_are_learnt(spark, documents):
    rows = [(100 * i + k, f"text{i} " * 50, f"l{i:02}", "a") for i in range(20) for k in range(20)]
    assert language_id.train(documents(*rows), most=1000).langs == [f"l{i:02}" for i in range(20)]


def test_all_text_is_counted(spark, documents):
    docs = documents(*[(i, f"{w} and more " * 120_000, "xx", "a") for i, w in enumerate(("plain", "simple", "other"))], (9, "short one", "yy", "a"))
    model, counts = language_id.train(docs), language_id.count_contexts(docs, "text", "lang").toPandas()
    whole = language_id.Model(counts.lang.tolist(), counts.gram.to_numpy(), counts.n.to_numpy())
    assert model.langs == ["xx", "yy"] and sum(model.trees[0].counts[0]) == sum(len(f"{w} and more " * 120_000) for w in ("plain", "simple", "other"))
    for one, other in zip(model.trees, whole.trees, strict=True):
        assert all(np.array_equal(a, b) for held in ("grams", "counts", "contexts", "stats") for a, b in zip(getattr(one, held), getattr(other, held), strict=True))


def test_long_texts_are_counted_whole(spark, documents, monkeypatch):
    docs = documents("the quick brown fox " * 50, "short")
    counts = lambda: sorted(map(tuple, language_id.count_contexts(docs, "text", "lang").collect()))
    whole = counts()
    monkeypatch.setattr(language_id, "CHUNK", 7)
    assert counts() == whole
