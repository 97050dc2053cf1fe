import hashlib
import math
import random
import re
from collections import Counter

import pytest

from hitloom.llm import pii, queries
from pyspark.sql import functions as F

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PATTERNS["card"] = r"[0-9]([ -]?[0-9])+"
PATTERNS["phone"] = r"\+[0-9][ ().0-9-]+[0-9]"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def slow_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


TEXTS = [
    "mail a.b@c.de, x@y and q@w.e.r.", "a@b.cc%d@e.ff @@x@y.z a@@b.c", "-@-.-", "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.255 1..2.3.4.5", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "4111  1111 1111 1111", "+49 (30) 123-4567 +1 2 +12345678901234567 ++49123456789)", "tel +1 (736) 555-2678.", "é@ü.com müller@bücher.de", "", "1234567890123456789012345", "+4111111111111111",
    "192.168.0.1@host.com 10.0.0.1:80", "x@a.b@c.d", "0000000000000000 00000000",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    assert [s[:3] for s in pii.base_spans(text)] == slow_spans(text)


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "a" * 200_000, "a@" * 50_000, "+1(" * 50_000, "1." * 100_000, "1 " * 100_000 + "x"):
        pii.base_spans(text)


def test_context_of_overlapping_spans():
    text = "near +4111111111111111 words"
    found = pii.context(text, pii.base_spans(text))
    assert {text[a:b] for _, _, a, b in found} == {"near", "words"}


def rows_of(df):
    out = df.select("doc_id", pii.listed("base").alias("base"), pii.listed("spans").alias("spans"))
    return {r.doc_id: (r.base, r.spans) for r in out.collect()}


def test_disclosing_terms(spark, documents):
    texts = [f"Today Zorbulon wrote from jo@x.org about weather number{chr(97 + i)} again" for i in range(4)]
    texts += [f"The weather again is fine and many talk about it today{chr(97 + i)}" for i in range(60)]
    rows = rows_of(pii.find_spans(documents(*texts)))
    for i in range(4):
        base, spans = rows[i]
        terms = {texts[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in spans.split(",")) if k == "term"}
        assert base == "email:26:34" and terms == {"Zorbulon", "wrote", "from"} | ({"Today"} & terms)
    assert all(rows[i] == ("", "") for i in range(4, 64))


def test_rare_meetings_do_not_disclose(spark, documents):
    rows = rows_of(pii.find_spans(documents("Zorbulon wrote jo@x.org", "quite another text")))
    assert rows == {0: ("email:15:23",) * 2, 1: ("", "")}


def test_edges(spark, documents, hard):
    found = pii.find_spans(hard)
    assert found.count() == 9 and found.where(F.size("base") > 0).count() == 0
    assert pii.find_spans(documents("a").limit(0)).count() == 0
    same = documents((1, "call +49 30 1234567", "en", "a"), (1, "call +49 30 1234567", "en", "a"), (None, "a@b.cd", None, None))
    assert sorted((str(r.doc_id), len(r.base)) for r in pii.find_spans(same).collect()) == [("1", 1), ("1", 1), ("None", 1)]


def test_redact(spark, documents, hard):
    docs = documents("to jo@x.org or 1.2.3.4!", None, "", "x +4111111111111111 y")
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["to [email] or [ip]!", None, "", "x +[card] y"]
    assert pii.redact(docs).columns == docs.columns
    assert pii.redact(hard).columns == hard.columns and sorted(map(str, pii.redact(hard).collect())) == sorted(map(str, hard.collect()))


def brute_disclosing(texts, reach=8, disclosure=0.95, support=3):
    """The disclosing words and their places, from plain counts over all texts."""
    word = re.compile(r"[^\W_]+")
    n, pairs = Counter(w.lower() for t in texts for w in word.findall(t)), Counter()
    for t in texts:
        spans = slow_spans(t)
        covered = {i for _, a, b in spans for i in range(a, b)}
        words = [m.span() for m in word.finditer(t)]
        for k, a, b in spans:
            digits = re.sub("[^0-9]", "", t[a:b])
            entity = (k, {0: t[a:b].lower(), 1: ".".join(str(int(p)) for p in t[a:b].split(".")) if k == 1 else ""}.get(k, digits))
            near = [w for w in words if w[1] <= a][-reach:] + [w for w in words if w[0] >= b][:reach]
            pairs.update((t[x:y].lower(), entity) for x, y in near if not covered & set(range(x, y)))
    around, total = Counter(), sum(n.values())
    for (_, e), c in pairs.items():
        around[e] += c
    told = set()
    for (w, e), c in pairs.items():
        c0 = min(c, n[w], around[e])
        if c >= support and math.log2(c0 * total / (n[w] * around[e])) / -math.log2(around[e] / total) >= disclosure:
            told.add(w)
    out = []
    for t in texts:
        spans = slow_spans(t)
        covered = {i for _, a, b in spans for i in range(a, b)}
        terms = [(4, *m.span()) for m in word.finditer(t) if m[0].lower() in told and not covered & set(range(*m.span()))]
        out.append(sorted(spans + terms, key=lambda s: (s[1], s[0], s[2])))
    return out


def test_query_beside_brute_force(spark, documents, tmp_path):
    """All columns of the registered query on texts with names, long words and wide gaps around entities."""
    rng = random.Random(7)
    stock = [f"w{i}" for i in range(60)] + ["x" * 120, "İstanbul", "É"]
    names = {"jo@x.org": "Zorbulon", "10.1.2.3": "Quex", "+49 30 1234567": "Li"}
    texts = []
    for i in range(150):
        words = [rng.choice(stock) for _ in range(rng.randrange(0, 25))]
        if i % 3 == 0:
            entity = list(names)[i % 9 // 3]
            at = rng.randrange(len(words) + 1)
            words[at:at] = [names[entity] + " " * rng.randrange(1, 60), entity]
        texts.append(" ".join(words))
    texts += ["Zorbulon far from it", "", None]
    docs = documents(*texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op7_disclosure(spark, str(tmp_path)).collect()}
    kinds = ("email", "ip", "card", "phone", "term")
    said = lambda spans: ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in spans)
    for i, spans in enumerate(brute_disclosing([t or "" for t in texts])):
        base = [s for s in spans if s[0] < 4]
        assert (got[i].spans, got[i].base_sha256) == (said(spans), hashlib.sha256(said(base).encode()).hexdigest()), texts[i]
        assert [got[i][f"n_{k}"] for k in kinds[:4]] == [sum(s[0] == k for s in base) for k in range(4)]


def test_ill_formed_texts(spark, documents):
    bad = F.concat(F.lit("a "), F.unhex(F.lit("c328f0")).cast("string"), F.lit(" jo@x.org end"))
    docs = documents("x").withColumn("text", bad)
    text = b"a \xc3(\xf0 jo@x.org end".decode("utf-8", "replace")
    (row,) = pii.find_spans(docs).collect()
    assert [text[s.start : s.end] for s in row.base] == ["jo@x.org"]
    assert pii.redact(docs).first().text == text.replace("jo@x.org", "[email]")
