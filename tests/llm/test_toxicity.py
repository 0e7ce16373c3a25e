from __future__ import annotations

import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from panelstats.llm import toxicity
from panelstats.llm.text import WordHashes


def test_learner_against_plain_ftrl():
    """One coordinate at a time, as the method is written down."""
    how = toxicity.Ftrl(alpha=0.5, beta=1.0, l1=0.3, l2=0.1, passes=3, positive=0.0)
    examples = [(np.array([0, 2]), 1), (np.array([1, 2]), 0), (np.array([0, 3]), 1), (np.array([3]), 0)]
    w, b = toxicity.learn(examples, bits=2, how=how)
    z, n = [0.0] * 5, [0.0] * 5

    def weight(i):
        l1 = how.l1 if i < 4 else 0.0
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2)

    for _ in range(3):
        for at, y in examples:
            at = [*at.tolist(), 4]
            ws = [weight(i) for i in at]
            g = 1 / (1 + np.exp(-sum(ws))) - y
            for i, wi in zip(at, ws, strict=True):
                s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / how.alpha
                z[i], n[i] = z[i] + g - s * wi, n[i] + g * g
    assert np.allclose([*w, b], [weight(i) for i in range(5)])


def test_features_are_a_set_and_ignore_case():
    hashes = WordHashes()
    assert (toxicity.features("A b c a B", hashes) == toxicity.features("a B C A b", hashes)).all()
    assert len(toxicity.features("x", hashes)) == 1 and len(toxicity.features(None, hashes)) == 0
    assert set(toxicity.features("a b", hashes)) < set(toxicity.features("a b q", hashes))


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels, train=toxicity.in_training(labels["doc_id"]))
    rows = toxicity.score_toxicity(docs, model).collect()
    return rows, {r.doc_id: r.toxic for r in labels.collect()}, model, docs


def test_held_out_rows(scored):
    rows, toxic, model, docs = scored
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.doc_id in toxic]
    pos, neg = ([r.score for r in held if toxic[r.doc_id] == k] for k in (1, 0))
    assert np.mean([[a > b for b in neg] for a in pos]) > 0.85
    assert sum(s >= 0.7 for s in neg) <= 0.05 * len(neg)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    assert len(model.at) < 20_000


def test_scores_against_dense_sum(scored):
    rows, _, model, docs = scored
    dense, hashes, texts = model.dense(), WordHashes(), {r.doc_id: r.text for r in docs.collect()}
    for r in rows[:60]:
        value = model.intercept + float(dense[toxicity.features(texts[r.doc_id], hashes)].sum())
        assert r.score == pytest.approx(1 / (1 + np.exp(-value)), abs=1e-6)


def test_odd_rows_and_labels(spark, odd_docs):
    odd = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (6, 0, "x"), (None, 1, "x"), (8, None, "x"), (99, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit_toxicity(odd_docs, odd)
    rows = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(odd_docs.limit(0), model).collect() == []
    none = toxicity.fit_toxicity(odd_docs, odd.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(odd_docs, none).collect()} == {0}
    only = toxicity.fit_toxicity(odd_docs, odd.filter("toxic = 1"))
    assert {r.predicted for r in toxicity.score_toxicity(odd_docs, only).collect()} == {1}


def test_sample_is_bounded_and_fixed(scored, labels):
    _, _, _, docs = scored
    a = toxicity.fit_toxicity(docs, labels, max_rows=20)
    b = toxicity.fit_toxicity(docs.repartition(5), labels.repartition(3), max_rows=20)
    assert (a.at == b.at).all() and np.allclose(a.weight, b.weight)


def test_one_labelled_id_with_many_rows(spark, labels):
    """Rows of one id are one example, whatever their number."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = labels.filter(toxicity.in_training(F.col("doc_id"))).join(docs, "doc_id").orderBy("doc_id").first()
    many = docs.unionByName(spark.range(500).select(F.lit(first.doc_id).alias("doc_id"), F.lit(first.text).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in docs.dtypes[2:])))
    models = [toxicity.fit_toxicity(d, labels, train=toxicity.in_training(F.col("doc_id"))) for d in (docs, many)]
    assert (models[0].at == models[1].at).all() and (models[0].weight == models[1].weight).all()


def test_held_out_is_never_null(spark):
    from panelstats.llm import lm

    ids = spark.createDataFrame([(None,), (1,), (3,)], "doc_id long")
    for train in (toxicity.in_training, lm.training_rows):
        got = {r[0]: r[1] for r in ids.select("doc_id", ~train(F.col("doc_id"))).collect()}
        assert got[None] is False and None not in got.values()
