from __future__ import annotations

import random

import xxhash

from panelstats.llm import simhash
from panelstats.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def plain_classes(ids, prints, distance=4):
    n = len(ids)
    links = [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= distance]
    root = roots(n, links)
    least = {}
    for i, r in enumerate(root):
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(r) for r in root]


def test_fingerprint_against_plain_counting():
    for text in ("", None, " \n", "one", "one two three", "a b c d", "A b C d e f a b c d", "é È É x y z", "w " * 500):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_is_spark_xxhash(spark):
    got = spark.sql("select xxhash64('abc def ghi jkl')").first()[0]
    assert simhash.fingerprint("abc def ghi jkl") == got % (1 << 64)


def test_every_near_pair_meets_in_an_upper_node():
    rng, masks = random.Random(3), simhash.masks()
    for _ in range(300):
        differ = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(differ & m == 0 for m in masks)


def check(df, rows):
    ids, prints = [r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows]
    want = sorted(zip(map(str, ids), (f"{p:016x}" for p in prints), map(str, plain_classes(ids, prints)), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect()) == want


def test_odd_rows(odd_docs, written):
    check(simhash.near_duplicates(written(odd_docs)), [(r.doc_id, r.text) for r in odd_docs.collect()])


def test_documents(documents):
    check(simhash.near_duplicates(documents), [(r.doc_id, r.text) for r in documents.collect()])


def test_empty_table(odd_docs):
    assert simhash.near_duplicates(odd_docs.limit(0)).collect() == []


def test_links_in_crowded_nodes(spark, written):
    """Many fingerprints around a few centres: upper nodes larger than a lower node, chains of links."""
    rng = random.Random(11)
    prints = {0}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(70):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                centre ^= 1 << b if rng.random() < 0.8 else 0
            prints.add(centre)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    distinct = written(spark.createDataFrame([(s,) for s in signed], "fp long"), 4)
    got = {r.node: r.root for r in components(simhash.links(distinct, leaf=8)).collect()}
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = roots(len(prints), links)
    groups = {}
    for i, r in enumerate(want):
        groups.setdefault(r, set()).add(got.get(signed[i], signed[i]))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(80)}}

