"""The registered quality classifier beside a slow interpolated modified Kneser-Ney model over words."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from hitloom.llm import quality_lm


def discounts_of(counts):
    n = Counter(counts)
    y = n[1] / (n[1] + 2 * n[2])
    return {0: 0.0, 1: 1 - 2 * y * n[2] / n[1], 2: 2 - 3 * y * n[3] / n[2], 3: 3 - 4 * y * n[4] / n[3]}


def pairs_of(text):
    words = text.split()
    return list(zip([None, *words[:-1]], words))


class Slow:
    """Both orders from whole counts, taken anew for each text that is scored without its own."""

    def __init__(self, trusted):
        self.counts = Counter(p for t in trusted for p in pairs_of(t))
        self.d2 = discounts_of(self.counts.values())
        self.d1 = discounts_of(Counter(w for _, w in self.counts).values())

    def bits(self, text, spelt, own):
        counts = self.counts - Counter(pairs_of(text)) if own else self.counts
        preceded = Counter(w for _, w in counts)
        total, cut = Counter(), defaultdict(float)
        for (u, _), n in counts.items():
            total[u] += n
            cut[u] += self.d2[min(n, 3)]
        every, cuts = sum(preceded.values()), sum(self.d1[min(n, 3)] for n in preceded.values())
        out = 0.0
        for (u, w), base in zip(pairs_of(text), spelt):
            one = (preceded[w] - self.d1[min(preceded[w], 3)]) / every + cuts / every * 2**-base
            n = counts[u, w]
            out -= math.log2((n - self.d2[min(n, 3)]) / total[u] + cut[u] / total[u] * one if total[u] else one)
        return out


@pytest.mark.parametrize("seed", [1, 2])
def test_classify_beside_slow_model(spark, documents, seed):
    draw = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfghjklm" for b in "aeiou" for c in ("n", "r", "s", "lo", "me", "ti", "xu")]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    prose = lambda n: " ".join(draw.choices(vocabulary, weights, k=n))
    rows = [(i, prose(draw.randint(1, 60)), "ab"[i % 2], "s") for i in range(80)]
    rows += [(100, "quite unknown words bar ban", "a", "s"), (101, "  ban\t ban\n\ncos ", "b", "s"), (102, "zz", "c", "s"), (103, None, "a", "s"), (104, "", "a", "s"), (105, rows[0][1], "a", "s")]
    trusted = {i for i in range(80) if i % 4} | {101}
    docs = documents(*rows)
    slow = Slow([t for i, t, *_ in rows if i in trusted])
    dense = quality_lm.train(docs.where(f"doc_id IN ({','.join(map(str, trusted))})")).table()
    want = {}
    for i, text, lang, _ in rows:
        if not text:
            continue
        data = text.encode()
        per_byte = dense[quality_lm.trigrams(data)].astype(float)
        spelt, blank, inside = [], 0.0, False
        for c, b in zip(data, per_byte):
            if chr(c).isspace():
                blank, inside = blank + b, False
                continue
            if not inside:
                spelt.append(0.0)
            spelt[-1], inside = spelt[-1] + b, True
        bits = slow.bits(text, spelt, i in trusted) + blank
        want[i] = (2 ** (bits / len(data)), 2 ** (per_byte.sum() / len(data)), lang)
    rank = lambda values: sorted(values)[max(math.ceil(0.9 * len(values)) - 1, 0)]
    limits = {lang: [rank([want[i][n] for i in trusted if lang in (None, want[i][2])]) for n in (0, 1)] for lang in ("a", "b", None)}
    found = {r.doc_id: r for r in quality_lm.classify(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), quantile=0.9).collect()}
    assert found.keys() == {r[0] for r in rows}
    for i, (perplexity, spelling, lang) in want.items():
        limit = limits[lang if lang in limits else None]
        assert np.isclose(found[i].perplexity, perplexity, rtol=1e-5) and np.isclose(found[i].threshold, limit[0], rtol=1e-5)
        assert found[i].keep == (perplexity <= limit[0] * (1 + 1e-6) and spelling <= limit[1] * (1 + 1e-6))
    assert not found[103].keep and found[104].perplexity is None
    assert 0 < sum(not found[i].keep for i in trusted) < len(trusted) / 2
