"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of buckets its words, neighbouring word pairs and pairs with one or two words between
hash to.  Weights are learnt one example at a time by FTRL-proximal: every coordinate has its own learning
rate, and L1 leaves at zero what the labels don't need, so that a few thousand weights are broadcast.

Labels are taken from a sample bounded by ``max_rows`` (all of them, if there are fewer): rows are chosen by
a hash of their id, so that the same table always gives the same sample, and are learnt from in one task.
Everything is scored.

Defined results: null and empty texts have the score of the intercept; labels of one document that differ
count as toxic; labels that are null or whose document is missing teach nothing; without labels of both
kinds every score is the share of toxic labels (0 without labels); repeated rows are scored alike; of rows with
the same labelled id the one with the least text is the example; null ids are kept, scored and never labelled; an empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WordHashes, lower_words, ngram_features

BITS = 20
GAPS = (1, 2, 3)
MAX_ROWS = 20_000
THRESHOLD = 0.7
_SAMPLE = 1 << 30


@dataclass(frozen=True)
class Ftrl:
    """Settings: rates ``alpha / (beta + sqrt(sum of squared gradients))``, L1, L2, passes, weight of toxic rows.

    The weight is ``positive`` times the share that balances both kinds.
    """

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 50.0
    l2: float = 0.0
    passes: int = 12
    positive: float = 1.0


@dataclass
class ToxicityModel:
    """Weights that aren't zero, by bucket."""

    at: np.ndarray
    weight: np.ndarray
    intercept: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        full = np.zeros(1 << self.bits, np.float32)
        full[self.at] = self.weight
        return full


def features(text: str | None, hashes: WordHashes, bits: int = BITS) -> np.ndarray:
    """Buckets of a text, each once."""
    some = hashes.of(lower_words(text))
    return np.unique(ngram_features(some, bits, GAPS)) if len(some) else np.empty(0, np.int64)


def learn(examples: list[tuple[np.ndarray, int]], bits: int = BITS, how: Ftrl = Ftrl()) -> tuple[np.ndarray, float]:
    """Dense weights and intercept after some passes over the examples in the given order."""
    size = (1 << bits) + 1  # the last coordinate is the intercept, which isn't regularised
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, how.l1)
    l1[-1] = 0.0

    def weights(at: np.ndarray | slice) -> np.ndarray:
        pulled = z[at] - np.sign(z[at]) * l1[at]
        return np.where(np.abs(z[at]) <= l1[at], 0.0, -pulled / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2))

    toxic = sum(label for _, label in examples)
    heavy = max(1.0, how.positive * (len(examples) - toxic) / max(toxic, 1))
    for _ in range(how.passes):
        for buckets, label in examples:
            at = np.append(buckets, size - 1)
            w = weights(at)
            gradient = (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (heavy if label else 1.0)
            grown = n[at] + gradient * gradient
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / how.alpha * w
            n[at] = grown
    final = weights(slice(None))
    return final[:-1], float(final[-1])


def in_training(id_col: Column) -> Column:
    """Rows that labels are learnt from: crc32 of the id as text isn't 1 modulo 3 (nor is that of a null id)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    train: Column | None = None,
    max_rows: int = MAX_ROWS,
    bits: int = BITS,
    how: Ftrl = Ftrl(),
) -> ToxicityModel:
    """Learn from at most about ``max_rows`` labelled documents; ``train`` filters the labels' ids."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known if train is None else known.filter(train)
    known = known.groupBy(F.col(id_col).alias("labelled")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    n = known.count()
    order = F.pmod(F.xxhash64("labelled", F.lit("toxicity")), F.lit(_SAMPLE))
    chosen = known.filter(order < min(_SAMPLE, _SAMPLE * max_rows // max(n, 1)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.join(F.broadcast(chosen), F.col("id") == F.col("labelled"))  # at most about max_rows pairs
    sample = found.groupBy("id", "toxic").agg(F.min("text").alias("text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for given in batches:
            found = [features(t, hashes, bits).astype("<i4").tobytes() for t in given.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [given.column(0), pa.array(found, pa.binary()), given.column(2)], names=["place", "buckets", "toxic"]
            )

    ready = sample.select(F.xxhash64("id", F.lit("order")).alias("place"), "text", "toxic").mapInArrow(
        featurise, "place long, buckets binary, toxic int"
    )

    def train_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for given in batches:
            if not given.num_rows:
                continue
            data = given.column(1)
            ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
            flat = np.frombuffer(data.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].copy().view("<i4")
            parts.append((given.column(0).to_numpy(), given.column(2).to_numpy(), np.diff(ends) // 4, flat))
        if not parts:
            return
        place, toxic, n = (np.concatenate([part[i] for part in parts]) for i in range(3))
        buckets = [some for _, _, n, flat in parts for some in np.split(flat, np.cumsum(n)[:-1])]  # views
        order = np.lexsort((n, toxic, place)).tolist()
        if toxic.min() < toxic.max():
            w, intercept = learn([(buckets[i], int(toxic[i])) for i in order], bits, how)
        else:
            w, intercept = np.zeros(1), 35.0 if toxic[0] else -35.0
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *at.tolist()], pa.int32()), pa.array([intercept, *w[at].tolist()], pa.float64())],
            names=["bucket", "weight"],
        )

    found = ready.repartition(1).mapInArrow(train_all, "bucket int, weight double").toPandas().sort_values("bucket")
    if found.empty:
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), -35.0, bits)
    at, w = found["bucket"].to_numpy(np.int64), found["weight"].to_numpy()
    return ToxicityModel(at[1:], w[1:].astype(np.float32), float(w[0]), bits)


def score_udf(model: ToxicityModel, docs: DataFrame):
    """A column function: the toxicity score of a text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, hashes = shared.value, WordHashes()
        dense = model.dense()

        def one(text: str | None) -> float:
            some = hashes.of(lower_words(text))
            value = model.intercept
            if len(some):
                at = ngram_features(some, model.bits, GAPS)
                at = np.unique(at[dense[at] != 0])
                value += float(dense[at].sum())
            return 1.0 / (1.0 + np.exp(-np.clip(value, -35, 35)))

        for some in texts:
            yield pd.Series([one(t) for t in some], dtype="float64")

    return toxicity


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score, predicted."""
    score = score_udf(model, docs)
    scored = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
