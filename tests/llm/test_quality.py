from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelstats.llm import quality
from panelstats.llm.text import WordHashes, ngram_features

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aäb#|<\n \x0b\t🙂 ", max_size=60))
def test_rules_against_plain_python(text):
    raw = text.encode()
    assert quality.base_rules(raw, raw.split()) == plain_rules(text)


def test_windows_of_many_different_words(monkeypatch):
    words = [b"%d" % (i % 3000) for i in range(7000)]
    assert quality.repeated_words(words) == 7000
    assert quality.repeated_words([b"%d" % i for i in range(7000)]) == 0


def check(df, docs):
    want = sorted((str(r.doc_id), *plain_rules(r.text)) for r in docs.collect())
    rows = df.collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    return rows


def test_documents(documents, labels):
    rows = check(quality.keep_quality(documents, labels), documents)
    good = {r.doc_id: r.quality for r in labels.collect()}
    decided = [(r.kept, good[r.doc_id]) for r in rows if not r.base_failed and r.doc_id in good]
    assert np.mean([k == q for k, q in decided]) > 0.9


def test_ratio_against_plain_counts(documents, labels):
    model = quality.fit_ratio(documents, labels, bits=10)
    hashes, sums = WordHashes(), np.zeros((2, 1 << 10))
    good = {r.doc_id: r.quality for r in labels.collect()}
    for r in documents.collect():
        some = hashes.of((r.text or "").encode().split())
        if len(some):
            at = np.bincount(ngram_features(some, 10, (1,)), minlength=1 << 10)
            sums[1] += at
            sums[0] += at * (good.get(r.doc_id) == 1)
    share = np.log(sums + 1) - np.log(sums.sum(1, keepdims=True) + (1 << 10))
    assert np.allclose(model.ratio, share[0] - share[1], atol=1e-5)


def test_odd_rows_and_labels(spark, odd_docs):
    odd = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (6, 1, "x"), (None, 1, "x"), (8, None, "x"), (99, 1, "x")], "doc_id long, quality int, text string")
    check(quality.keep_quality(odd_docs, odd), odd_docs)
    rows = check(quality.keep_quality(odd_docs, odd.limit(0)), odd_docs)
    assert all(r.kept != r.base_failed for r in rows)
    assert quality.keep_quality(odd_docs.limit(0), odd).collect() == []


def test_threshold_halves_the_gap():
    steps = {-40: (0, 5), -20: (0, 5), 10: (7, 0), 12: (3, 0)}
    assert quality.best_threshold(steps) == pytest.approx(quality.STEP * (-19 + 10) / 2)
    assert quality.best_threshold({1: (3, 0)}) == float("-inf") == quality.best_threshold({})
