"""Deep-shallow sorting, and removal of repeated byte strings against plain Python."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from panelcheck.compare import difference
from panelstats.llm import repeats
from panelstats.llm.queries import ORACLES, QUERIES
from panelstats.llm.suffixes import BlindTrie, agreement, classes_by_depth, common_prefix, deep_shallow
from tests.conftest import SF_DIR


def some_strings(seed, n=300, size=20, letters=b"ab\0"):
    rng = random.Random(seed)
    stems = [bytes(rng.choice(letters) for _ in range(size)) for _ in range(6)]
    made = []
    for _ in range(n):
        stem, cut = rng.choice(stems), rng.randrange(size + 1)
        made.append(stem[:cut] + bytes(rng.choice(letters) for _ in range(size - cut)))
    return made


@pytest.mark.parametrize("shallow", [0, 4, 8, 24, 100])
def test_order_is_that_of_sorting(shallow):
    for seed in range(6):
        strings = some_strings(seed)
        order = deep_shallow(strings, shallow=shallow)
        assert sorted(order) == list(range(len(strings)))
        assert [strings[i] for i in order] == sorted(strings)
    assert deep_shallow([]) == [] and deep_shallow([b"x"]) == [0]
    assert sorted(deep_shallow([b"same"] * 5, shallow=shallow)) == list(range(5))


def test_blind_trie_alone():
    strings = some_strings(9, letters=b"\0\xff")
    trie = BlindTrie(strings)
    for i in range(len(strings)):
        trie.add(i)
    assert [strings[i] for i in trie.in_order()] == sorted(strings)
    assert BlindTrie([]).in_order() == []


def test_classes_tell_equal_prefixes():
    strings = some_strings(4, n=60)
    order = deep_shallow(strings)
    depths = np.arange(21)
    found = classes_by_depth(np.array(order), agreement(strings, order), depths)
    for i, a in enumerate(strings):
        for j, b in enumerate(strings):
            assert common_prefix(a, b) == next((k for k in range(20) if a[k] != b[k]), 20)
            assert [found[i, d] == found[j, d] for d in depths] == [a[:d] == b[:d] for d in depths]


def test_equal_strings_have_equal_anchors():
    rng = random.Random(1)
    passage = bytes(rng.choice(b"abcdefgh ") for _ in range(100))
    (anchor,), _ = repeats.anchors_of(passage)
    for before in (0, 1, 40, 300):
        text = bytes(rng.choice(b"abcdefgh ") for _ in range(before)) + passage + bytes(rng.choice(b"xyz") for _ in range(200))
        at, _ = repeats.anchors_of(text)
        assert before + anchor in at


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = repeats.anchors_of(text)
    monkeypatch.setattr(repeats, "PART", 700)
    parts = repeats.anchors_of(text)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def plain(rows, length=100):
    """The contract, string by string; rows are (doc_id, text) in the table's order."""
    ranked = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), [None] * len(rows)
    for i in ranked:
        data = (rows[i][1] or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            s = data[at : at + length]
            if s in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for j, g in enumerate(gone) if g and (not j or not gone[j - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = (rows[i][0], len(data), sum(gone), runs, kept)
    return out


def removed(df, **how):
    got = repeats.remove_repeats(df, **how).collect()
    for r in got:
        ends = [(s.begin, s.end) for s in r.removed]
        assert all(a < b for a, b in ends) and all(x[1] < y[0] for x, y in zip(ends[:-1], ends[1:], strict=True))
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.removed), len(r.removed), bytes(r.kept)) for r in got), key=str)


def shared_texts(seed, n=60, length=100, letters="abcdé "):
    """Texts put together from passages that many share, some overlapping themselves."""
    rng = random.Random(seed)
    passages = ["".join(rng.choice(letters) for _ in range(rng.randrange(length // 2, 3 * length))) for _ in range(8)]
    passages += ["ab" * length, " " * (2 * length), passages[0][: length - 1], passages[0] + passages[0][:50]]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p)) if rng.random() < 0.5 else 0
            parts += [p[a:], "".join(rng.choice(letters) for _ in range(rng.randrange(60)))]
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("how", [{}, {"most": 1}, {"length": 24, "gram": 7}, {"length": 24, "gram": 23, "most": 3}])
def test_against_plain_python(spark, written, how):
    length = how.get("length", 100)
    texts = shared_texts(5, length=length)
    rows = [((7 * i) % 61, t) for i, t in enumerate(texts)]  # ids in another order than rows
    df = written(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert removed(df, **how) == sorted(plain(rows, length), key=str)


def test_small_lots(spark, written, monkeypatch):
    monkeypatch.setattr(repeats, "LOT", 5)
    monkeypatch.setattr(repeats, "SORTED", 7)
    rows = list(enumerate(shared_texts(6)))
    df = written(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert removed(df) == sorted(plain(rows), key=str)


def test_odd_rows(spark, odd_docs, written):
    df = written(odd_docs, 1)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert removed(df) == sorted(plain(rows), key=str)
    assert removed(written(odd_docs.filter("doc_id = 99"))) == []


def test_a_group_of_copies_keeps_the_first(spark, written):
    text = shared_texts(7, n=1)[0] + "x" * 150
    rows = [(1000 - i, text) for i in range(900)] + [(2000 + i, f"{i} {text[:120]} {i}") for i in range(300)]
    df = written(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    assert removed(df) == sorted(plain(rows), key=str)


def test_query_equals_its_sql(spark, con):
    name = "op12_suffix_dedup"
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_query_on_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    want = [(i, n, gone, runs, hashlib.sha256(kept).hexdigest()) for i, n, gone, runs, kept in plain(rows)]
    got = QUERIES["op12_suffix_dedup"](spark, SF_DIR)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if SF_DIR.endswith("sf0.001"):
        assert sorted(map(tuple, got.collect())) == sorted(want)
