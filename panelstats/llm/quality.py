"""Quality rules: counted rules first, then a likelihood ratio of hashed n-grams.

Words and neighbouring word pairs are hashed into buckets.  Two multinomials are counted over all
documents: the trusted target (documents labelled as good) and the raw corpus (all of them).  A document's
score is the mean, over its n-grams, of ``log p_target(bucket) - log p_raw(bucket)``, both smoothed.  It is
kept if the score reaches a threshold, which is read off the scores of all labelled documents: the place
that keeps as many good ones and rejects as many bad ones as possible.  Every document is decided, and
the same input always gives the same decision.

Defined results: null and empty texts have no words, fail the counted rules and have score 0; a table
without labels of both kinds keeps whatever passes the counted rules (threshold minus infinity); labels
of one document that differ count as bad; repeated rows are decided alike; an empty table gives an
empty result; null ids are kept and never labelled.  Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats.shared import stored

from .text import WordHashes, batch, ngram_features, raw

BITS = 17
SMOOTHING = 1.0
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Scores are compared in steps of this size, and lie within so many steps of 0 for the threshold's sake.
STEP, STEPS = 0.005, 4000
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_CONTINUES = bytes(range(0x80, 0xC0))


# -- counted rules -------------------------------------------------------------------------------


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    window, base = ids[:n], len(seen)
    for k in range(1, width):
        if base * len(seen) >= 2**62:  # numbers of windows so far, instead of their values
            window = np.unique(window, return_inverse=True)[1]
            base = int(window.max()) + 1
        window, base = window * len(seen) + ids[k : k + n], base * len(seen)
    order = np.argsort(window)
    ordered = window[order]
    equal = ordered[1:] == ordered[:-1]
    if not equal.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + n] |= twice
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def base_rules(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.translate(None, _CONTINUES))
    return len(words), chars, len(_SYMBOLS.findall(text)), repeated_lines(text), repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words


# -- likelihood ratio ----------------------------------------------------------------------------


@dataclass
class RatioModel:
    """Log ratio of each bucket of hashed n-grams."""

    ratio: np.ndarray
    bits: int = BITS

    def score(self, hashes: np.ndarray) -> float:
        if not len(hashes):
            return 0.0
        return float(self.ratio[ngram_features(hashes, self.bits, (1,))].mean())


def good_or_bad(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """One row per labelled id: labelled_id, good (1 or 0)."""
    return (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("labelled_id"))
        .agg(F.min(F.col(label_col).cast("int")).alias("good"))
    )


def fit_ratio(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    bits: int = BITS,
) -> RatioModel:
    """Both multinomials over all documents; a task sums its n-grams before anything is shuffled.

    Labels are joined by hash, so texts are moved once and never sorted.  The driver gets the sums of at
    most ``2 ** bits`` buckets.
    """
    known = good_or_bad(labels, id_col, label_col).hint("shuffle_hash")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = rows.join(known, rows["id"] == known["labelled_id"], "left").select("text", "good")
    schema = pa.schema([("bucket", pa.int32()), ("target", pa.int64()), ("raw", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums = WordHashes(), np.zeros((2, 1 << bits), np.int64)
        for given in batches:
            for text, good in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True):
                some = hashes.of(raw(text).split())
                if len(some):
                    found, times = np.unique(ngram_features(some, bits, (1,)), return_counts=True)
                    sums[1, found] += times
                    if good == 1:
                        sums[0, found] += times
        at = np.flatnonzero(sums[1])
        yield batch(schema, bucket=at.astype(np.int32), target=sums[0][at], raw=sums[1][at])

    counted = (
        marked.mapInArrow(count, "bucket int, target long, raw long")
        .groupBy("bucket")
        .agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
        .toPandas()
    )
    sums = np.zeros((2, 1 << bits))
    sums[:, counted["bucket"]] = counted["target"], counted["raw"]
    share = np.log(sums + SMOOTHING) - np.log(sums.sum(axis=1, keepdims=True) + SMOOTHING * (1 << bits))
    return RatioModel((share[0] - share[1]).astype(np.float32), bits)


def score_quality(docs: DataFrame, model: RatioModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the counted rules, base_failed and the score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    counted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ratio = WordHashes(), shared.value
        for given in batches:
            found = []
            for text in given.column(1).to_pylist():
                text = raw(text)
                words = text.split()
                rules = base_rules(text, words)
                found.append((*rules, base_failed(rules[0], rules[4]), ratio.score(hashes.of(words))))
            columns = list(zip(*found, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [given.column(0), *map(pa.array, columns, kinds)],
                names=["doc_id", *counted, "base_failed", "score"],
            )

    longs = ", ".join(f"{n} long" for n in counted)
    return rows.mapInArrow(score, f"doc_id {rows.dtypes[0][1]}, {longs}, base_failed boolean, score double")


def fit_threshold(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> float:
    """Threshold from all labelled documents that pass the counted rules; the driver gets sums per step."""
    known = good_or_bad(labels, id_col, label_col)
    step = F.greatest(F.lit(-STEPS), F.least(F.lit(STEPS), F.floor(F.col("score") / STEP))).cast("int")
    steps = (
        scored.filter(~F.col("base_failed"))
        .select("doc_id", step.alias("step"))
        .join(known, F.col("doc_id") == known["labelled_id"])
        .groupBy("step")
        .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    )
    return best_threshold({r["step"]: (r["good"], r["bad"]) for r in steps.collect()})


def keep_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """Counted rules, score and decision of every row: the columns of ``score_quality``, then kept."""
    model = fit_ratio(docs, labels, id_col, text_col, label_col)
    scored = stored(score_quality(docs, model, id_col, text_col), "quality-scores")
    threshold = fit_threshold(scored, labels, id_col, label_col)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def best_threshold(steps: dict[int, tuple[int, int]]) -> float:
    """The step that rejects most bad and fewest good documents, each as a share of its kind.

    Between equally good steps the middle one is taken, so that a gap between the kinds is halved.
    """
    good, bad = (sum(c[k] for c in steps.values()) for k in (0, 1))
    if not good or not bad:
        return float("-inf")
    order = sorted(steps)
    gain, best, run = 0.0, 0.0, [order[0]]
    for step, above in zip(order, [*order[1:], order[-1] + 1], strict=True):
        gain += steps[step][1] / bad - steps[step][0] / good
        if gain > best + 1e-12:
            best, run = gain, [step + 1, above]
    return STEP * (run[0] + run[-1]) / 2
