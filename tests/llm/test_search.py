"""Blocked search against scoring every document in plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from panelcheck.compare import difference
from panelstats.llm import search
from panelstats.llm.heaps import Heaps
from panelstats.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_DIR

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, best=50):
    """The contract, document by document; docs and items are (id, text)."""
    split = [(i, Counter(w), len(w)) for i, t in docs for w in [words(t)]]
    n_docs, total = sum(n > 0 for _, _, n in split), sum(n for _, _, n in split)
    df = Counter(t for _, c, _ in split for t in c)
    out = []
    for item, terms in sorted({(i, tuple(sorted(set(words(t))))) for i, t in items}, key=str):
        found = []
        for doc, c, n in split:
            m = 50 + 50 * n * n_docs // total if total else 0
            score = 0
            for t in terms:
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:best], 1)]
    return sorted(out, key=str)


def searched(docs, items, **how):
    got = search.search(docs, items, **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def corpus(seed, n=400, vocabulary=120):
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(vocabulary)] + ["été", "Straße", "日本"]
    often = [1 / (1 + i) for i in range(len(names))]
    docs = [(i, " ".join(rng.choices(names, often, k=rng.randrange(0, 60)))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(60)]  # copies: equal scores
    items = [(i, " ".join(rng.choices(names, k=rng.randrange(1, 12)))) for i in range(25)]
    return docs, items


def frames(spark, written, docs, items, parts=4):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, terms string, n int")
    i = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, score int")
    return written(d, parts), written(i, 2)


def test_terms():
    text = "Ab9\x00c_d`E{f\x7fé Ü x y\tZ-1"
    assert [t.decode() for t in search.terms_of(text)] == words(text) == ["ab9", "c", "d", "e", "f", "é", "Ü x y", "z", "1"]
    assert search.terms_of(None) == search.terms_of("") == search.terms_of(" .,") == []


@pytest.mark.parametrize("best", [7, 1000])
def test_against_plain_python(spark, written, best):
    docs, items = corpus(1)
    assert searched(*frames(spark, written, docs, items), best=best) == plain(docs, items, best)


def test_chunks_of_items_and_small_lots(spark, written, monkeypatch):
    monkeypatch.setattr(search, "DOCS", 23)
    monkeypatch.setattr(search, "SAMPLE", 40)
    docs, items = corpus(2)
    assert searched(*frames(spark, written, docs, items), best=9, terms=20) == plain(docs, items, 9)


def test_odd_rows(spark, odd_docs, written):
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    items = [(1, "alpha GAMMA word1"), (1, "alpha GAMMA word1"), (1, "other"), (2, None), (3, ""), (4, " . "), (None, "no id"), (5, "nowhere")]
    given = written(spark.createDataFrame(items, "item_id long, text string"), 2)
    assert searched(written(odd_docs), given) == plain(docs, items)
    assert searched(written(odd_docs.filter("doc_id = 99")), given) == []
    assert searched(written(odd_docs), given.filter("item_id = 99")) == []


def test_summaries_bound_scores_and_blocks_are_skipped():
    rng = np.random.default_rng(5)
    n, size = 3000, 200
    rows = [np.unique(rng.zipf(1.4, 30) % size) for _ in range(n)]
    term, begin = np.concatenate(rows), np.r_[0, np.cumsum([len(r) for r in rows])]
    rank = np.empty(size, np.int64)
    rank[np.argsort(np.bincount(term, minlength=size), kind="stable")] = np.arange(size)
    term = np.concatenate([np.sort(rank[r]) for r in rows])
    lot = search.Lot(np.arange(n), begin, term, rng.integers(1, 1000, len(term)), size)
    blocks = search.Blocks(lot, np.arange(size))
    assert sorted(blocks.doc.tolist()) == sorted(lot.doc.tolist())
    item = np.sort(rng.choice(size, 12, replace=False))
    bound = blocks.bounds(item)
    for b in range(len(blocks.term)):
        for d in blocks.doc[blocks.begin[b] : blocks.begin[b + 1]].tolist():
            row = slice(begin[d], begin[d + 1])
            assert blocks.term[b] in term[row]
            assert lot.gain[row][np.isin(term[row], item) & (term[row] >= blocks.term[b])].sum() <= bound[b]
    heaps = Heaps(1, 10, once=False)
    heaps.least[:] = 1
    scored = search.search_lot(lot, [item], heaps)
    wanted = np.zeros(size, np.int64)
    wanted[item] = 1
    scores = lot.scores(np.arange(n), wanted)
    best = sorted(zip((-scores).tolist(), range(n), strict=True))[:10]
    assert [(-s, d) for s, d in zip(heaps.score.tolist(), heaps.id.tolist(), strict=True)] == best
    assert 10 <= scored < 0.7 * (scores > 0).sum()  # the others were not looked at


def test_query_equals_its_sql(spark, con):
    name = "op13_ranked_search"
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None
