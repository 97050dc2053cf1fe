"""URL rules, decontamination, sharding."""

import itertools
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash

from hitloom.llm import decontaminate, sharding, url_filter
from hitloom.llm.queries import URL_RULES, op9_shard_slots

URLS = [
    "https://www.example.com/en/71?x#y", "http://EXAMPLE.com/en/6", "https://a.net/de/8", "https://x.example.net/de/80", "https://example.net/de", "ftp://notcom/en/", "https://com/en/",
    "https://xcom/en/", "nourl", "", None, "https://org?/es/", "https://a.b.c.org/es/#", "http://É.com/en/", "://com/en/", "http://u:p@com:80/en/", "a://b://com/en/", "https://x..com/en/",
]


def brute_judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize(("broadcast", "shapes"), [(50_000, 16), (50_000, 2), (0, 16)])
def test_url_rules(spark, monkeypatch, broadcast, shapes):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", broadcast)
    monkeypatch.setattr(url_filter, "FEW_SHAPES", shapes)
    rules = [*URL_RULES, ("net", "/", "block"), ("c.org", "", "allow")]
    pages = spark.createDataFrame([(i, u, "old", "s") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, rule string, labels string")
    given = spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    out = url_filter.judge(pages, given)
    assert {(r.page_id, (r.host, r.path, r.rule, r.verdict)) for r in out.collect()} == {(i, brute_judge(u, rules)) for i, u in enumerate(URLS + URLS[:3])}
    assert all(r.labels == "s" for r in out.collect())
    assert {r.verdict for r in url_filter.judge(pages, given.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), given).count() == 0


@pytest.mark.parametrize("shapes", [16, 0])
def test_host_and_path_do_not_run_together(spark, monkeypatch, shapes):
    monkeypatch.setattr(url_filter, "FEW_SHAPES", shapes)
    rules = spark.createDataFrame([("a.co", "m", "block"), ("b.org", "", "allow"), ("c.org/x", "", "block")], "host string, path string, verdict string")
    long = "https://c.org/" + "x/" * 50_000
    pages = spark.createDataFrame([(1, "https://a.com"), (2, "https://a.com/x"), (3, "http://b.org"), (4, "https://c.org/x"), (5, long)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got == {1: (None, "allow"), 2: (None, "allow"), 3: ("b.org", "allow"), 4: (None, "allow"), 5: (None, "allow")}


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if ord(c) >= 128 or c.isalnum():
            word += c.lower() if ord(c) < 128 else c
        elif word:
            out.append(word)
            word = ""
    return out


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for i in range(max(1, len(x) - 9) if x else 0):
            window = x[i : i + 10]
            for j in range(len(w) - len(window) + 1):
                if w[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    found.add(str(item))
    return len(w), sorted(hit), sorted(found)


ITEMS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "Short Item!"),
    (10, "the the the the the the the the the the the"),
    (3, ""),
    (4, None),
    (5, "Ärger straße été alpha beta gamma delta epsilon zeta eta theta"),
    (2, "another, with the same id"),
]
DOCS = [
    "x alpha beta gamma, delta epsilon zeta eta theta iota KAPPA y",
    "alpha beta gamma delta epsilon zeta eta theta iota",
    "a short item and a short  item; shortitem",
    "the " * 14,
    "été ALPHA beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu",
    None,
    "",
    "another with the same id",
    "straße ÉTÉ alpha",
]


def test_contamination(spark, documents, hard):
    bench = spark.createDataFrame([*ITEMS, (None, "plain words of a small text here")], "item_id long, text string")
    docs = documents(*DOCS, DOCS[0])
    rows = {r.doc_id: (r.n_words, list(r.hits), list(r["items"])) for r in decontaminate.contamination(docs, bench).collect()}
    assert rows == {i: brute_hits(t, ITEMS) for i, t in enumerate([*DOCS, DOCS[0]])}
    clean = decontaminate.decontaminate(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, (_, hits, _) in rows.items() if not hits}
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(hard, bench).columns == hard.columns and decontaminate.decontaminate(hard, bench).count() == 9


def test_proximity(spark, documents):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    docs = documents("red green blue", "red nice green blue", "blue green red", "red one two three green blue")
    near = decontaminate.contamination(docs, bench, slop=1)
    assert {r.doc_id: r.hits for r in near.where("n_hit > 0").collect()} == {0: [0, 1, 2], 1: [0, 2, 3]}


def test_proximity_beside_brute_force():
    """Each word of a window on a position of its own, at most ``slop`` off, for some start."""
    rng = random.Random(4)
    for _ in range(200):
        doc, item = [rng.choice("abc") for _ in range(7)], [rng.choice("abc") for _ in range(3)]
        hit, slop = set(), rng.choice((1, 2))
        for start in range(-4, 12):
            fits = [p for p in itertools.permutations(range(len(doc)), 3) if all(doc[x] == item[i] and abs(x - start - i) <= slop for i, x in enumerate(p))]
            hit |= {x for p in fits for x in p}
        phrases = decontaminate.Phrases([("1", " ".join(item).encode())])
        terms, lengths, at = decontaminate.postings(decontaminate.terms_of(" ".join(doc).encode()))
        phrases.plan(np.ones(len(phrases.vocabulary)))
        lists = dict(zip(terms.tolist(), np.split(at, np.cumsum(lengths)[:-1]), strict=True))
        found = phrases.match({t: p for t, p in lists.items() if t in phrases.vocabulary}, slop)
        assert bool(found) == bool(hit) and {x for p, _ in found for x in p} <= hit
        assert all(len(set(p)) == 3 for p, _ in found)


def test_benchmarks_in_parts(spark, documents, monkeypatch):
    docs, bench = documents(*DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", 100)
    rows = {r.doc_id: (r.n_words, list(r.hits), list(r["items"])) for r in decontaminate.contamination(docs, bench).collect()}
    assert rows == {i: brute_hits(t, ITEMS) for i, t in enumerate(DOCS)}


def test_an_index_serves_later_benchmarks(spark, documents):
    index = decontaminate.build_index(documents(*DOCS))
    for items in ([(1, "short item")], [(7, "straße été")], []):
        bench = spark.createDataFrame(items, "item_id long, text string")
        rows = {r.doc_id: (r.n_words, list(r.hits), list(r["items"])) for r in decontaminate.search(index, bench).collect()}
        assert rows == {i: brute_hits(t, items) for i, t in enumerate(DOCS)}


def test_shards(spark, documents, hard, tmp_path):
    docs = documents(*[(i, "é" * (i % 50), "en", "a") for i in range(2000)])
    rows = sharding.shard_rows(docs, 8, map_path=str(tmp_path / "map")).collect()
    assert len(rows) == 2000
    sums = {}
    for r in rows:
        text = "é" * (r.doc_id % 50)
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "bytes", None)
        sums.setdefault(r.shard, []).append((r.slot, r["size"]))
    assert sorted(sums) == list(range(8))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in sums.values())
    total = [sum(n for _, n in v) for v in sums.values()]
    assert max(total) - min(total) <= 0.01 * sum(total)
    again = sharding.shard_rows(docs.repartition(5), 8).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}
    stored = sharding.load_map(spark, str(tmp_path / "map"), 1)
    assert all(stored[r.vslot] == r.shard for r in rows)
    with pytest.raises(Exception):  # noqa: B017 - a version is written once
        sharding.save_map(spark, str(tmp_path / "map"), 1, stored)
    assert sharding.shard_rows(hard).count() == 9 and sharding.shard_rows(docs.limit(0)).count() == 0
    assert {r.text_crc32 for r in sharding.shard_rows(hard).where("doc_id IN (2, 3)").collect()} == {0}


def test_stored_map_places_later_records(spark, documents, tmp_path):
    path = str(tmp_path / "map")
    first = sharding.shard_rows(documents(*[f"text {i}" for i in range(4000)]), 8, map_path=path).collect()
    grown = sharding.shard_rows(documents(*[f"text {i}" + " more" * (i // 3000) for i in range(4400)]), 8, map_path=path).collect()
    assert sharding.latest_version(spark, path) == 2
    old, new = ({r.doc_id: r for r in x} for x in (first, grown))
    same = [i for i in range(3000) if old[i].shard == new[i].shard]
    assert all(old[i].vslot == new[i].vslot for i in range(3000)) and len(same) > 2000
    sums = [sum(r["size"] for r in grown if r.shard == s) for s in range(8)]
    assert max(sums) - min(sums) <= 0.01 * sum(sums)


def brute_shards(rows, shards=8, slots=sharding.SLOTS):
    """(doc_id, size, crc, shard, slot) of (doc_id, text) rows, in plain Python."""
    digest = lambda data: (xxhash.xxh64_intdigest(data, seed=42) ^ (1 << 63)) - (1 << 63)
    told = []
    for doc_id, text in rows:
        data = (text or "").encode()
        vslot = digest(struct.pack("<q", 42 if text is None else digest(data))) % slots
        told.append([vslot, doc_id, zlib.crc32(data), len(data) + 1])
    sizes, counts = {}, {}
    for vslot, _, _, size in told:
        sizes[vslot], counts[vslot] = sizes.get(vslot, 0) + size, counts.get(vslot, 0) + 1
    where = sharding.rebalanced(sharding.balanced(sizes, shards, slots), sizes, shards, sharding.WITHIN)
    most = -(-len(told) // slots)
    for x in told:
        key = 42 if x[1] is None else digest(struct.pack("<q", x[1]))
        x.insert(1, key % -(-counts[x[0]] // most))
    out, nth = [], [0] * shards
    for vslot, _, doc_id, crc, size in sorted(told, key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0, x[3], x[4])):
        shard = where[vslot]
        out.append((doc_id, size, crc, shard, nth[shard]))
        nth[shard] += 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("copies", [3, 3000])
def test_shards_beside_brute_force(documents, copies):
    """Equal texts stay together, a third of all rows too."""
    texts = [f"group {i % 700} " + "x" * (i % 300) for i in range(2100)] + ["hot"] * copies + [None, None, "", "é"]
    docs = documents(*texts)
    rows = sharding.shard_rows(docs.repartition(3), 8).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in rows), key=repr) == brute_shards(list(enumerate(texts)))
    shards = {}
    for r in rows:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(x) == 1 for x in shards.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_runs_of_the_shard_query_do_not_meet(spark, sf):
    """Runs over other tables in between change nothing, and no group is split."""
    run = lambda x: {(r.doc_id, r.shard, r.slot) for r in op9_shard_slots(spark, f"/root/testdata/{x}").collect()}
    first = run(sf)
    run("sf0.001")
    assert run(sf) == first
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    assert len({(texts[i], shard) for i, shard, _ in first}) == len(set(texts.values()))


def test_rebalancing_moves_little():
    sizes = {s: 1 + s % 13 for s in range(400)}
    first = sharding.balanced(sizes, 8, 400)
    load = lambda m, n: [sum(sizes[s] for s in sizes if m[s] == k) for k in range(n)]
    assert sharding.rebalanced(first, sizes, 8) == first
    grown = sharding.rebalanced(first, sizes, 9)
    moved = [s for s in sizes if grown[s] != first[s]]
    assert max(load(grown, 9)) - min(load(grown, 9)) <= 0.05 * sum(sizes.values()) / 9
    assert sum(sizes[s] for s in moved) <= 1.2 * sum(sizes.values()) / 9 and {grown[s] for s in moved} == {8}
    fewer = sharding.rebalanced(first, sizes, 7)
    assert all(fewer[s] == first[s] for s in sizes if first[s] < 7) and max(fewer) == 6


