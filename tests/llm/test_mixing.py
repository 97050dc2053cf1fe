import hashlib
import re

from pyspark.sql import functions as F

from hitloom.llm import mixing


def shares(totals, most=3):
    """Targets by resharing what is above the caps, round by round."""
    names = sorted((n for n in totals if n is not None)) + [None] * (None in totals)
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    out, left, free = {}, float(sum(totals.values())), list(names)
    while free:
        level = left / sum(weight[n] for n in free)
        full = [n for n in free if level * weight[n] > most * totals[n]]
        if not full:
            return out | {n: level * weight[n] for n in free}
        for n in full:
            out[n] = float(most * totals[n])
            left -= out[n]
        free = [n for n in free if n not in full]
    return out


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = {}
    for _, t, _, s in rows:
        totals[s] = totals.get(s, 0) + size(t)
    targets = shares(totals)
    out = []
    for s, total in totals.items():
        epochs = int(targets[s] // total) if total else 0
        budget, before = targets[s] - epochs * total, 0
        keyed = []
        for i, t, _, x in rows:
            if x == s:
                n, symbols = size(t), len(re.findall(r"[!-/:-@\[-`{-~]", t or ""))
                u = (int(hashlib.md5(str(i if i is not None else "").encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                keyed.append((1 - u ** (1 / (n / (n + symbols) if n else 1.0)), i or 0, n))
        for _, i, n in sorted(keyed):
            out.append((i, n, total, round(targets[s], 6), n * (epochs + (budget > 0 and before + n / 2 <= budget))))
            before += n
    return sorted(out)


def test_against_sorting(spark, documents):
    rows = [(i, " ".join(["w!"[: 1 + i % 2]] * (i % 17)), "en", ["b", "a", None, "é", "Z", ""][i * i % 6]) for i in range(400)]
    rows += [(1000 + i, "x " * 400, "en", "big") for i in range(30)]
    got = sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_words(documents(*rows)).collect())
    assert got == brute(rows)


def test_targets_are_met(spark, documents):
    rows = [(i, "w " * (1 + i % 40), "en", "ab"[i % 7 == 0] if i % 50 else None) for i in range(3000)]
    found = mixing.mix_words(documents(*rows)).groupBy("source_size", "target").sum("taken", "size").collect()
    assert len(found) == 3
    for r in found:
        assert abs(r["sum(taken)"] - r.target) <= 20 and r.target <= 3 * r.source_size
    assert abs(sum(r.target for r in found) - sum(r.source_size for r in found)) < 1e-6


def test_copies_follow_the_plan(spark, documents, hard):
    docs = documents(*[(i, "one two three", "en", "a" if i else "b") for i in range(20)])
    taken = {r.doc_id: r.taken // 3 for r in mixing.mix_words(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}
    again = mixing.mix(docs.repartition(3)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in again} == {i: n for i, n in taken.items() if n}
    assert mixing.mix(hard).columns == hard.columns
    assert mixing.mix_words(hard).count() == 9
    assert mixing.mix_words(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_repeated_empty_texts(spark, documents):
    rows = mixing.mix_words(documents(None, "", " ", (3, None, None, None))).collect()
    assert [(r["size"], r.taken) for r in rows] == [(0, 0)] * 4 and {r.target for r in rows} == {0.0}


def test_small_weights_keep_their_order(spark):
    for weight in (1.0, 0.03, 0.01, 1e-5):
        drawn = spark.range(4000).select("id", mixing.draw(F.col("id"), F.lit(weight)).alias("key"))
        keys = {r.id: r.key for r in drawn.collect()}
        u = {i: (int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in keys}
        assert len(set(keys.values())) == 4000 and all(0 < k < 1 for k in keys.values())
        assert sorted(keys, key=keys.get) == sorted(u, key=u.get, reverse=True)


def test_symbols_rule_the_weights(spark, documents):
    """Texts that are nearly all symbols: the mix still meets its targets and takes words first."""
    noise = [(i, "x" + "!" * 300, "en", "s") for i in range(600)]
    words = [(1000 + i, "x", "en", "s") for i in range(600)]
    rows = noise + words + [(5000, "y " * 3000, "en", "t")]
    got = {r.doc_id: r.taken for r in mixing.mix_words(documents(*rows)).collect()}
    target = shares({"s": 1200, "t": 3000})["s"]
    assert abs(sum(got[i] for i, *_ in noise + words) - target) <= 1
    more = lambda part: sum(got[i] - int(target // 1200) for i, *_ in part)
    assert more(words) > 20 * more(noise)
