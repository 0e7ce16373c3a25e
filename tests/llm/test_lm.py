from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from panelstats.llm import gru, lm

F64 = np.float64


def tiny(seed=0, words=11, shapes=3, hidden=5, classes=4):
    rng = np.random.default_rng(seed)
    counts = np.sort(rng.integers(1, 90, words + shapes))[::-1].astype(F64)
    shape = gru.Shape(words, shapes, gru.frequency_classes(counts[:words], classes), hidden)
    p = gru.initial(shape, counts)
    return shape, {k: (v + rng.normal(0, 0.4, v.shape)).astype(np.float32) for k, v in p.items()}, rng


def plain_distribution(p, shape, state):
    """Log-probability of every token after a state."""
    softmax = lambda x: x - np.log(np.exp(x).sum())
    classes = softmax(p["class_w"].astype(F64) @ state + p["class_b"][:, 0])
    out = []
    for k in range(shape.classes):
        a, b = shape.begins[k], shape.begins[k + 1]
        out.extend(classes[k] + softmax(p["word_w"][a:b].astype(F64) @ state + p["word_b"][a:b, 0]))
    return np.array([*out, *classes[shape.classes :]])


def plain_score(p, shape, tokens, end):
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, state, given, total = shape.hidden, np.zeros(shape.hidden), end, 0.0
    for target in tokens:
        x, a = p["in"][given].astype(F64), state @ p["rec"].astype(F64)
        r, z = sigmoid(x[:h] + a[:h]), sigmoid(x[h : 2 * h] + a[h : 2 * h])
        fresh = np.tanh(x[2 * h :] + r * a[2 * h :])
        state = fresh + z * (state - fresh)
        logs = plain_distribution(p, shape, state)
        assert np.exp(logs).sum() == pytest.approx(1)
        total += logs[target]
        given = target
    return total


def test_scores_of_whole_documents_in_any_lanes_and_windows():
    shape, p, rng = tiny()
    documents = [rng.integers(0, 14, n) for n in (1, 2, 30, 7, 64, 5, 1, 19)]
    want = [plain_score(p, shape, d, 0) for d in documents]
    for width, steps in ((1, 7), (3, 5), (20, 128)):
        assert np.allclose(gru.score(p, shape, documents, 0, width, steps), want, atol=1e-3)
    assert len(gru.score(p, shape, [], 0)) == 0


def test_large_logits_don_t_overflow():
    shape, p, rng = tiny()
    p["class_b"] += 500
    p["word_b"] -= 500
    documents = [rng.integers(0, 14, 9)]
    assert np.allclose(gru.score(p, shape, documents, 0), [plain_score(p, shape, documents[0], 0)], atol=1e-2)


def test_gradients_against_differences(monkeypatch):
    """One window without carried state: an Adagrad step from zero squares shows the gradient's sign and size."""
    shape, p, rng = tiny(3)
    documents = [rng.integers(0, 14, 6), rng.integers(0, 14, 4)]
    n = sum(map(len, documents))
    loss = lambda q: -gru.score(q, shape, documents, 0).sum() / n
    squares = {k: np.full_like(v, 1e8) for k, v in p.items()}  # step = -rate * gradient / 1e4
    moved = {k: v.copy() for k, v in p.items()}
    gru.train(moved, shape, documents, 0, squares, rate=1e4, width=2, steps=50)
    for name, v in p.items():
        got = v - moved[name]
        for at in [tuple(rng.integers(0, s) for s in v.shape) for _ in range(12)]:
            up, down = ({k: a.copy() for k, a in p.items()} for _ in range(2))
            up[name][at] += 0.02
            down[name][at] -= 0.02
            assert got[at] == pytest.approx((loss(up) - loss(down)) / 0.04, abs=2e-3)


def test_training_lowers_the_loss():
    shape, p, rng = tiny(5)
    documents = [np.tile([1, 4, 2, 9], 12) for _ in range(20)]
    before = gru.score(p, shape, documents, 0).sum()
    squares = gru.no_squares(p)
    for _ in range(5):
        gru.train(p, shape, documents, 0, squares)
    assert gru.score(p, shape, documents, 0).sum() > 0.5 * before


def check(df, rows, train):
    """Counts and base scores against plain Python."""
    tokens = [((text or "").encode().lower().split()) + [b""] for _, text in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if train(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), len(ws), sum(w in counts for w in ws), n, round(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4))
        for (i, _), ws in zip(rows, tokens, strict=True)
    )
    got = df.collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)
    return got


def held_out(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def test_documents(documents, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    monkeypatch.setattr(lm, "COUNTED", 500)
    monkeypatch.setattr(lm, "SCORED", 3000)
    got = check(lm.score_documents(documents, lm.training_rows(documents["doc_id"])), rows, lambda i: not held_out(i))
    held = [r for r in got if held_out(r.doc_id)]
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)


def test_a_small_head_gives_the_same_base(documents, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    whole = lm.vocabulary
    monkeypatch.setattr(lm, "vocabulary", lambda counts: whole(counts, words=50, head=200))
    check(lm.score_documents(documents, lm.training_rows(documents["doc_id"])), rows, lambda i: not held_out(i))


def test_odd_rows(odd_docs, written):
    docs = written(odd_docs)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check(lm.score_documents(docs), rows, lambda i: True)
    assert lm.score_documents(docs.limit(0)).collect() == []


def test_nothing_to_learn_from(odd_docs):
    from pyspark.sql import functions as F

    got = lm.score_documents(odd_docs, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)}


def test_vocabulary(spark):
    words = {b"": 5, b"the": 9, b"a": 9, b"b.": 2, b"\xc3\xa9": 1, b"z!": 1, b"y": 1}
    counts = spark.createDataFrame([(bytearray(w), lm.word_shape(w), c) for w, c in words.items()], "word binary, shape int, c long")
    known = lm.vocabulary(counts, words=3, head=100)
    assert known.head[:4] == [b"", b"a", b"the", b"b."] and known.words == 3 and known.total == 28 and known.distinct == 7
    assert known.unseen.tolist() == [1.0, 1.0, 0.1, 0.1, 1.0, 0.1]
    assert known.rest == pytest.approx([2.1, 2.1, 2.2, 0.1, 2.1, 0.1])
    assert lm.vocabulary(counts, words=3, head=2).head == [b"", b"a", b"the"]


def test_windows_are_spread_over_the_document():
    tokens = np.arange(1000)
    for share, chosen in ((4, 0), (4, 7), (5, 123456789)):
        some = lm.windows(tokens, chosen, share, 48)
        assert [int(w[0]) // 48 % share for w in some] == [chosen % share] * len(some)
        assert abs(sum(map(len, some)) - 1000 / share) <= 48
    assert [w.tolist() for w in lm.windows(np.arange(3), 99, 5, 48)] == [[0, 1, 2]]
    assert [len(w) for w in lm.windows(np.arange(60), 1, 5, 48)] == [12]


def test_scores_do_not_depend_on_files(documents, written, monkeypatch):
    """One file or eight, several copies: the same scores."""
    monkeypatch.setattr(lm, "COPY", 3000)
    monkeypatch.setattr(lm, "ADDED", 2)
    found = []
    for parts in (1, 8):
        docs = written(documents, parts)
        found.append({r.doc_id: r.score for r in lm.score_documents(docs, lm.training_rows(docs["doc_id"])).collect()})
    assert found[0].keys() == found[1].keys()
    assert max(abs(a - found[1][i]) for i, a in found[0].items()) < 1e-3 * max(1, max(map(abs, found[0].values())) / 1000)


def test_gain_over_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in lm.score_documents(docs, lm.training_rows(docs["doc_id"])).collect() if held_out(r.doc_id)]
    tokens = sum(r.n_tokens for r in held)
    assert (sum(r.score for r in held) - sum(r.base_score for r in held)) / tokens > 0.2


def test_all_training_tokens_are_looked_at(spark):
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(i * 40 % 700))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = lm.vocabulary(lm.count_words(docs))
    found = lm.training_windows(docs, known, 3).collect()
    tokens = Counter(t for r in found for t in np.frombuffer(r.tokens, "<i4").tolist())
    assert sum(tokens.values()) == known.total
    assert [tokens[i] for i in range(known.words)] == known.counts[: known.words].tolist()
