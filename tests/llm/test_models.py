"""Kneser-Ney quality, toxicity, language identification: against slow versions and held-out rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitloom.llm import language_id, quality_lm, toxicity

SF = "/root/testdata/sf0.01"


def slow_kneser_ney(texts):
    """p(c | a b) of a byte trigram model, straight from the definition."""
    tri = Counter(g for t in texts for g in zip(b"\0\0" + t, b"\0" + t, t, strict=False))
    bi = Counter((b, c) for _, b, c in tri)
    uni = Counter(c for _, c in bi)

    def level(counts):
        k = Counter(counts.values())
        d = quality_lm.discounts([k[i] for i in (1, 2, 3, 4)])
        return lambda n: d[min(n, 3) - 1]

    cuts = [level(x) for x in (uni, bi, tri)]

    def p(gram):
        prob = 1 / 256
        for size, counts, cut in ((1, uni, cuts[0]), (2, bi, cuts[1]), (3, tri, cuts[2])):
            own = gram[3 - size :]
            same = {(k if size > 1 else (k,)): n for k, n in counts.items() if (k if size > 1 else (k,))[:-1] == own[:-1]}
            total = sum(same.values())
            if total:
                n = same.get(own, 0)
                prob = ((n - cut(n)) / total if n else 0) + sum(cut(x) for x in same.values()) / total * prob
        return prob

    return p


def test_kneser_ney(spark, documents):
    texts = ["abab abc abd abe", "abracadabra", "été à", "", None]
    model = quality_lm.train(documents(*texts))
    table = model.table()
    assert np.allclose(np.exp2(-table.reshape(65536, 256)).sum(axis=1), 1, atol=1e-4)
    p = slow_kneser_ney([t.encode() for t in texts if t])
    for text in ("abab", "zzz", "aé"):
        grams = list(zip(b"\0\0" + text.encode(), b"\0" + text.encode(), text.encode(), strict=False))
        assert math.isclose(sum(table[(a << 16) | (b << 8) | c] for a, b, c in grams), -sum(math.log2(p(g)) for g in grams), rel_tol=1e-4)


def test_long_texts_are_scored_whole(spark, documents, monkeypatch):
    docs = documents("the quick brown fox " * 50 + "!!", "short")
    model = quality_lm.train(docs)
    whole = [r.perplexity for r in quality_lm.perplexity(docs, model, "text", ("doc_id",)).orderBy("doc_id").collect()]
    monkeypatch.setattr(quality_lm, "CHUNK", 7)
    assert np.allclose([r.perplexity for r in quality_lm.perplexity(docs, model, "text", ("doc_id",)).orderBy("doc_id").collect()], whole)
    counts = lambda: sorted(map(tuple, quality_lm.count_trigrams(docs, "text").collect()))
    cut = counts()
    monkeypatch.setattr(quality_lm, "CHUNK", 1 << 22)
    assert counts() == cut


def test_quality_keeps_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_lm.classify(docs, labels.where("quality = 1").select("doc_id")).join(labels, "doc_id").toPandas()
    assert len(rows) and rows[rows.quality == 1].keep.mean() > 0.97
    assert rows[rows.quality == 0].keep.mean() < 0.35


def test_quality_edges(spark, documents, hard):
    ids = spark.createDataFrame([(1,), (None,), (4,)], "doc_id long")
    rows = quality_lm.classify(hard, ids).collect()
    assert len(rows) == 9 and {r.keep for r in rows if not r.n_bytes} == {False}
    none = quality_lm.classify(documents("abc", ""), ids.limit(0)).orderBy("doc_id").collect()
    assert [(round(r.perplexity), r.threshold, r.keep) for r in none[:1]] == [(256, None, True)] and not none[1].keep
    assert quality_lm.classify(documents("a").limit(0), ids).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = F.col("doc_id")
    rows = toxicity.score_documents(docs, labels.where(~toxicity.held_out(out))).join(labels, "doc_id").where(toxicity.held_out(out)).toPandas()
    wrong = rows[(rows.score >= toxicity.THRESHOLD) & (rows.toxic == 0)]
    found = rows[(rows.toxic == 1) & (rows.score >= toxicity.THRESHOLD)]
    assert len(wrong) == 0 and len(found) >= 0.7 * (rows.toxic == 1).sum() and rows.score.between(0, 1).all()


def random_model(seed=5):
    rng = np.random.default_rng(seed)
    examples = []
    for i in range(500):
        terms = rng.choice(40, int(rng.integers(0, 6)), replace=False).tolist()
        examples.append((i, int(rng.integers(2)), 1.0, terms, rng.integers(1, 4, len(terms)).tolist()))
    model = toxicity.Model({f"t{i:03}": i for i in range(40)}, rng.uniform(0.03, 1, 40), 0.1, list(examples))
    model.build(1000, rng.integers(1, 900, 40))
    return model, rng, {e[0]: dict(zip(e[3], e[4], strict=True)) for e in examples}


def test_nearest_is_exact():
    model, rng, examples = random_model()
    vectors = {i: dict(zip(*(x.tolist() for x in model.vector(examples[name])), strict=True)) for i, name in enumerate(model.ids)}
    for _ in range(50):
        query = {int(t): int(rng.integers(1, 4)) for t in rng.choice(40, 4, replace=False)}
        weight = dict(zip(*(x.tolist() for x in model.vector(query)), strict=True))
        sims = [(sum(weight.get(t, 0) * x for t, x in v.items()), i) for i, v in vectors.items()]
        want = sorted((s for s, i in sims if s > 0), reverse=True)[: toxicity.NEIGHBOURS]
        got = model.nearest(query)
        assert np.allclose([s for s, _ in got], want) and all(np.isclose(s, dict((i, x) for x, i in sims)[i]) for s, i in got)
    assert model.nearest({}) == [] and model.score({})[0] == 0.1


def test_toxicity_beside_brute_force(spark, documents):
    """Scores of all documents from TF-IDF vectors written out in full."""
    rng = np.random.default_rng(3)
    stock = [f"word{i}" for i in range(30)]
    texts = {i: " ".join(rng.choice(stock, 12)) + (" vile" if i % 4 == 0 else "") for i in range(60)}
    texts[60], texts[61], texts[62] = texts[0] + " word1", "", texts[8]
    docs = documents(*[(i, t, "en", "a") for i, t in texts.items()])
    labels = {i: int(i % 4 == 0) for i in range(0, 40)} | {62: 1}
    table = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, table).collect()}
    counts = {i: toxicity.term_counts(t.encode()) for i, t in texts.items()}
    weights = {i: 1.0 for i in labels if i != 62}
    weights[8] += 1  # 62 is its copy
    ones, zeros = sum(labels[i] for i in weights), sum(1 - labels[i] for i in weights)

    def relevance(term):
        a, b = sum(term in counts[i] and labels[i] for i in weights), sum(term in counts[i] and not labels[i] for i in weights)
        share = (a + b) / (ones + zeros)
        part = lambda n, total, p: n * math.log(n / (total * p)) if n else 0.0
        ratio = 2 * (part(a, ones, share) + part(b, zeros, share) + part(ones - a, ones, 1 - share) + part(zeros - b, zeros, 1 - share))
        return min(1.0, max(0.03, (ratio / 20) ** 2))

    space = {t for i in weights for t in counts[i]}
    heft = {t: (math.log((1 + len(texts)) / (1 + sum(t in c for c in counts.values()))) + 1) * relevance(t) for t in space}

    def vector(c):
        v = {t: (1 + math.log(n)) * heft[t] for t, n in c.items() if t in heft}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = {i: vector(counts[i]) for i in weights}
    base = (sum(w * labels[i] for i, w in weights.items()) + 1) / (sum(weights.values()) + 2)
    for i, c in counts.items():
        q = vector(c) if c else {}
        near = sorted(((sum(q.get(t, 0) * x for t, x in v.items()), j) for j, v in vectors.items()), reverse=True)[:15]
        near = [(s, j) for s, j in near if s > 0]
        votes = sum(s * weights[j] for s, j in near)
        want = (sum(s * weights[j] * labels[j] for s, j in near) + 0.25 * base) / (votes + 0.25)
        assert np.isclose(got[i].score, want, atol=1e-9), i
        assert np.allclose([e.similarity for e in got[i].evidence], [s for s, _ in near])


def test_ill_formed_texts(spark, documents):
    bad = F.concat(F.lit("badly formed "), F.unhex(F.lit("ff41c3")).cast("string"), F.lit(" vile text"))
    docs = documents("a plain text of some words", "another vile text").unionByName(documents((9, "x", "en", "a")).withColumn("text", bad))
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    assert toxicity.score_documents(docs, labels).count() == 3 and toxicity.reject(docs, labels, threshold=2.0).count() == 3
    model = language_id.train(docs)
    assert {r.lang_pred for r in language_id.identify(docs, model).collect()} == {"en"}


def test_toxicity_edges(spark, documents, hard):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.score_documents(hard, labels).count() == 9
    assert toxicity.reject(hard, labels, threshold=2.0).columns == hard.columns
    none = toxicity.score_documents(documents("a b", None), labels.limit(0)).collect()
    assert [r.score for r in none] == [0.5, 0.5] and all(r.evidence == [] for r in none)
    assert toxicity.score_documents(documents("a").limit(0), labels).count() == 0


def slow_bits(text, grams):
    """Code length under method C with exclusions, straight from the counts."""
    total, order = 0.0, language_id.ORDER
    data = [256] * order + list(text)
    for i in range(order, len(data)):
        seen, done = set(), False
        for size in range(order, -1, -1):
            context = tuple(data[i - size : i])
            if 256 in context:
                continue
            n = Counter()
            for g, k in grams.items():
                if g[order - size : order] == context and g[order] not in seen:
                    n[g[order]] += k
            if not n:
                continue
            base = sum(n.values()) + len(n)
            if data[i] in n:
                total -= math.log2(n[data[i]] / base)
                done = True
                break
            total -= math.log2(len(n) / base)
            seen |= set(n)
        if not done:
            total += math.log2(256 - len(seen))
    return total


@pytest.mark.parametrize("text", [b"abab", b"a", b"zzza", "éa".encode(), b"", b"banana bandana" * 3, b"abracadabrabanana", b"nananab"])
def test_code_lengths(text, monkeypatch):
    corpus = {"x": [b"abracadabra", b"banana", b"bananas and cadabra"], "y": ["éàé".encode(), b"zz", b"ab"]}
    langs, codes, counts, grams = [], [], [], {}
    for name, texts in corpus.items():
        grams[name] = Counter()
        for t in texts:
            data = [256] * 4 + list(t)
            grams[name].update(tuple(data[i - 4 : i + 1]) for i in range(4, len(data)))
        for g, n in grams[name].items():
            langs.append(name)
            codes.append(sum(x * 257 ** (4 - i) for i, x in enumerate(g)))
            counts.append(n)
    model = language_id.Model(langs, np.array(codes), np.array(counts))
    want = [slow_bits(text, grams[x]) for x in model.langs]
    for kept, chunk in ((1 << 22, 1 << 22), (4, 4)):
        monkeypatch.setattr(language_id, "KEPT", kept)
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        coder = model.coder()
        coder.chunk = chunk
        got = coder.bits([text, b"", text, b"other" * 9, text])
        assert np.allclose(got[[0, 2, 4]], want, atol=1e-3) and (got[1] == 0).all()
        assert np.allclose(coder.bits([text])[0], want, atol=1e-3)


def test_many_languages_share_the_sample(spark, documents):
    docs = documents(*[(i, f"text number {i} of its own language", f"l{i % 1200:04}", "a") for i in range(2400)])
    assert len(language_id.train(docs).langs) == 1200
    kept = language_id.sample(docs, "text", "lang", 2_000_000, total=1200).groupBy("lang").count().collect()
    assert len(kept) == 1200 and sum(r["count"] for r in kept) < 1300


def test_ties_go_to_the_first_language(spark, documents):
    model = language_id.train(documents((1, "same words", "b", "s"), (2, "same words", "a", "s")))
    (row,) = language_id.identify(documents("same"), model).collect()
    assert row.lang_pred == "a" and abs(row.score - 0.5) < 1e-6


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))), most=200_000)
    rows = language_id.identify(docs, model, keep=("doc_id", "lang")).where(language_id.held_out(F.col("doc_id"))).toPandas()
    assert len(rows) > 200 and (rows.lang == rows.lang_pred).mean() > 0.99


def test_language_edges(spark, documents, hard):
    model = language_id.train(hard)
    rows = language_id.identify(hard, model).collect()
    assert len(rows) == 9 and {r.lang_pred for r in rows if r.doc_id in (2, 3, 6)} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows)
    nothing = language_id.train(documents((1, "a", None, "s")))
    assert [(r.lang_pred, r.score) for r in language_id.identify(documents("abc"), nothing).collect()] == [("und", 0.0)]
    assert language_id.identify(documents("a").limit(0), model).count() == 0


def test_copies_meet_beside_an_unlike_text_with_a_smaller_id(spark):
    """Texts that share boilerplate share MinHash values: the smallest id of a value may be unlike both copies."""
    boilerplate = " ".join(f"shared{i}" for i in range(120))
    rows = [(0, 1, 1.0, boilerplate + " " + " ".join(f"own{i}" for i in range(40)))]
    for n in range(40):
        base = boilerplate + " " + " ".join(f"body{n}x{i}" for i in range(60))
        rows += [(10 + 2 * n, n % 2, 1.0, base), (11 + 2 * n, n % 2, 2.0, base + " end")]
    merged = toxicity.merge_copies(spark.createDataFrame(rows, "id long, y int, weight double, text string")).collect()
    assert {r.id: r.weight for r in merged} == {0: 1.0, **{10 + 2 * n: 3.0 for n in range(40)}}
