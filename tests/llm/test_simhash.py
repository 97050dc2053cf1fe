import random
import re

import numpy as np
import pytest
import xxhash

from hitloom.llm import simhash


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(space, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = ["One two three FOUR", "ÄÖ ä b c", "a", "", None, "x y", "a  b\tc\nd", "A b C", "a b c a b c a b c"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == slow_fingerprint(text)


def brute_components(fps):
    label = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            if (a ^ b).bit_count() <= 3 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def planted(n=60, seed=1):
    """Random fingerprints, chains of two- and three-bit steps around some, and far ones."""
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 1 << 63, n, dtype=np.uint64)]
    for x in out[:12]:
        for _ in range(4):
            for b in rng.choice(64, 3, replace=False):
                x ^= 1 << int(b)
            out.append(x)
    return list(dict.fromkeys(out + [0, 7, 15, (1 << 64) - 1]))


@pytest.mark.parametrize("cell", [20_000, 1])
def test_links_against_all_pairs(spark, cell):
    from hitloom.llm.common import components

    fps = planted()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    links = simhash.link_forest(df, cell=cell)
    roots = {r.node: r.root for r in components(links).collect()}
    got = [roots.get(signed(x), signed(x)) for x in fps]
    want = brute_components(fps)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_tree_finds_every_link():
    members = np.array(planted(seed=2), dtype=np.uint64)
    found = {(int(m), int(q)) for m, near in simhash.BKTree(members).links(members) for q in near}
    assert found == {(int(a), int(b)) for a in members for b in members if (int(a) ^ int(b)).bit_count() <= 3}


def test_deep_tree():
    members = np.array([(1 << i) - 1 for i in range(64)], dtype=np.uint64)
    assert len(simhash._forest(members, 1)) == 63


def test_documents(spark, documents, hard):
    docs = documents("a b c d e", "A b c D e", "other words stand here now", "", None, "q")
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    fps = [slow_fingerprint(t) for t in texts]
    assert {i: f for i, (f, _) in rows.items()} == {i: f"{x:016x}" for i, x in enumerate(fps)}
    assert [rows[i][1] for i in range(6)] == brute_components(fps)
    assert rows[3] == ("0" * 16, 3) and rows[4] == ("0" * 16, 3)
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    found = simhash.simhash_components(hard).collect()
    assert len(found) == 9 and {r.component_id for r in found if r.doc_id is None} == {2, None}
    assert {r.component_id for r in found if r.doc_id in (1, 5)} == {1}


def test_dedup(spark, documents, hard):
    docs = documents("a b c d e", "A b c D e", "other words stand here now", "", None)
    assert sorted(r.doc_id for r in simhash.dedup(docs).collect()) == [0, 2, 3]
    kept = simhash.dedup(hard)
    assert kept.columns == hard.columns
    # The null texts, the empty one and the one of symbols: 2 stands for the group of fingerprint 0.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 4), (False, 6), (True, 0)]
    assert simhash.dedup(docs.limit(0)).count() == 0
    alone = documents((None, "x y z w", "en", "a"), (None, "x y z w", "en", "a"), (None, "quite another text is this", "en", "a"))
    assert simhash.dedup(alone).count() == 2


def five_word_sets(texts):
    out = []
    for t in texts:
        words = [w for w in re.split("[ \t-\r]+", (t or "")) if w]
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
        out.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def similar_groups(texts):
    """Smallest index of each text's group, from the exact similarity of all pairs; and the number of linked pairs."""
    sets, group, links = five_word_sets(texts), list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if not both or len(sets[i] & sets[j]) >= 0.8 * both:
                links.append((i, j))
    for _ in texts:
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    return group, links


def edited_texts(seed=1):
    rng, texts = random.Random(seed), []
    for n in (4, 12, 40, 200, 700):
        for _ in range(8):
            words = [f"w{rng.randrange(5000)}" for _ in range(n)]
            texts.append(" ".join(words))
            for share in (0.0, 0.01, 0.03, 0.1, 0.3):
                texts.append(" ".join("X" + w if rng.random() < share else w for w in words))
    return texts + ["", None, " "]


@pytest.mark.parametrize(("cell_bytes", "keys"), [(32 << 20, 1_000_000), (3000, 0)])
def test_near_copies_beside_all_pairs(spark, documents, monkeypatch, cell_bytes, keys):
    """No group is wider than the links of all pairs make it, and nearly all links are found."""
    monkeypatch.setattr(simhash.copy_links, "__defaults__", (cell_bytes,))
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", keys)
    texts = edited_texts()
    docs = documents(*texts, (5, texts[5], "en", "a"))
    want, links = similar_groups(texts)
    roots = {r.id: r.root for r in simhash.near_copies(docs).collect()}
    assert all(want[i] == want[j] for i in range(len(texts)) for j in range(i) if roots[i] == roots[j])
    found = [roots[i] == roots[j] for i, j in links]
    assert sum(found) >= 0.97 * len(found)
    kept = sorted(r.doc_id for r in simhash.dedup(docs).collect())
    least = {}
    for i, r in roots.items():
        least[r] = min(least.get(r, i), i)
    assert kept == sorted(least.values())


def test_the_tree_prunes():
    """A search visits only the children whose edge lies within the radius of its own distance."""
    rng = np.random.default_rng(8)
    members = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    tree, visited = simhash.BKTree(members), 0
    todo = [tree]
    query = members[1234]
    while todo:
        node = todo.pop()
        visited += 1
        gap = int(np.bitwise_count(query ^ node.root))
        todo += [c for e, c in node.children.items() if abs(e - gap) <= 3]
    assert visited < len(members) / 2
    assert [int(m) for m, _ in tree.links(np.array([query]))] == [int(query)]
