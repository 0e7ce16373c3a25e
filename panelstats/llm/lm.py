"""Language-model scores of whole documents.

Words and an end token are counted over all training documents; the counts give the base score and the
frequencies that a gated recurrent model (``gru``) starts from.  Copies of the model are trained by truncated
backpropagation, each on documents that a hash of their id and text deals to it, in an order that hash gives, and
averaged row by row, by how often each row was used: how the table is cut into files or tasks doesn't matter.
Every training document takes part with all its tokens, in windows of ``window``; a ``share`` above 1 takes every
``share``-th window (one at least), from one on that the hash chooses.  Copies are as many as these tokens ask for.  Scores are over all tokens of every document, with the state carried from window to window.

The probability of a word without weights of its own is that of its shape (how it ends, and whether it is
ASCII) times its share of the counts of such words.  Words not met in training are one outcome of their
shape; it weighs as much as the words met once.

The most frequent words (at most ``head``) are known to all tasks; rarer ones meet their counts in a join.

Defined results: a null text is empty, an empty document is its end token; without training documents
``N`` and ``V`` are 0 and every base score is 0; null ids are scored and count as training documents; a very long
word is one token, and is known to all tasks if it is frequent; repeated rows are scored alike; an empty table gives an empty result.  Only the
named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstats.shared import stored

from . import gru
from .text import batch, lower_words

WORDS, CLASSES, HEAD = 8000, 60, 1 << 18
SHARE, WINDOW = 1, 48
#: Tokens that a copy is trained on about, and at a time; copies added up at a time.
COPY, LOT, ADDED = 1_000_000, 100_000, 64
RATE = 0.1
#: Words counted at a time, and tokens scored at a time, in a task.
COUNTED, SCORED = 300_000, 1_500_000
#: Rows of a parameter array that are averaged together.
BLOCK = 512
END = b""
SHAPES = 6


def word_shape(word: bytes) -> int:
    """Ends in a letter, in a stop or comma, or otherwise; twice that, plus one if it isn't ASCII."""
    last = word[-1] if word else 97
    kind = 0 if 97 <= last <= 122 or last >= 128 else 1 if last in b".," else 2
    return 2 * kind + (not word.isascii())


def training_rows(id_col: Column) -> Column:
    """Rows to learn from: crc32 of the id as text isn't divisible by 10 (nor is that of a null id)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 10 != 0, F.lit(True))


# -- counts --------------------------------------------------------------------------------------


def count_words(docs: DataFrame) -> DataFrame:
    """word, shape, c over the texts (column text), the end token included."""
    schema = pa.schema([("word", pa.binary()), ("shape", pa.int32()), ("n", pa.int64())])

    def part(counts: Counter) -> pa.RecordBatch:
        words = list(counts)
        return batch(schema, word=words, shape=[word_shape(w) for w in words], n=list(counts.values()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for given in batches:
            for text in given.column(0).to_pylist():
                counts.update(lower_words(text))
            counts[END] += given.num_rows
            if len(counts) > COUNTED:
                yield part(counts)
                counts = Counter()
        if counts:
            yield part(counts)

    rows = docs.select("text").mapInArrow(count, "word binary, shape int, n long")
    return rows.groupBy("word", "shape").agg(F.sum("n").alias("c")).filter(F.col("c") > 0)


@dataclass
class Vocabulary:
    """Frequent words by number (the end token is 0) and what is known of all others."""

    head: list[bytes]
    counts: np.ndarray
    words: int
    total: int
    distinct: int
    rest: np.ndarray  # weight of each shape: its words without weights, and the unseen
    unseen: np.ndarray

    def per_number(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token of the model, log10 count, and log10 share of its shape, for each number, then each shape."""
        shape = np.array([word_shape(w) for w in self.head], np.int64)
        own = np.arange(len(self.head)) < self.words
        token = np.r_[np.where(own, np.arange(len(self.head)), self.words + shape), self.words + np.arange(SHAPES)]
        log_count = np.r_[np.log10(self.counts + 0.1), np.zeros(SHAPES)]
        log_rest = np.log10(self.rest)
        share = np.r_[np.where(own, 0.0, log_count[: len(own)] - log_rest[shape]), -log_rest]
        return token, log_count, share

    def shape_of_model(self) -> tuple[gru.Shape, np.ndarray]:
        counts = np.r_[self.counts[: self.words], self.rest].astype(np.float64)
        return gru.Shape(self.words, SHAPES, gru.frequency_classes(self.counts[: self.words] + 0.1, CLASSES)), counts


def vocabulary(counts: DataFrame, words: int = WORDS, head: int = HEAD) -> Vocabulary:
    """From a stored table of ``count_words``; the driver gets ``head`` words at most.

    They are the words from a count on that leaves no more of them; counts are binned for that, so that
    the driver sees a few hundred bins whatever the corpus.
    """
    sums = counts.agg(F.sum("c").alias("total"), F.count("*").alias("distinct"), F.sum(F.when(F.col("word") == END, F.col("c"))).alias("ends")).first()
    level = F.floor(F.log2("c") * 16).cast("int")
    plain = counts.filter(F.col("word") != END)
    bins = {r["level"]: r["n"] for r in plain.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    least, held = 1 << 30, 0
    for at in sorted(bins, reverse=True):
        held += bins[at]
        if held > head:
            break
        least = at
    top = plain.filter(level >= least).select("word", "c").toPandas()
    top = top.assign(word=top["word"].map(bytes)).sort_values(["c", "word"], ascending=[False, True])
    known = [END, *top["word"]]
    number = np.r_[sums["ends"] or 0, top["c"].to_numpy(np.int64)]
    own = min(words, len(known))
    others = plain
    if own > 1:
        last_word, last = known[own - 1], int(number[own - 1])
        others = plain.filter((F.col("c") < last) | ((F.col("c") == last) & (F.col("word") > F.lit(last_word))))
    rest, unseen = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in others.groupBy("shape").agg(F.sum(F.col("c") + 0.1).alias("mass"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect():
        rest[r["shape"]], unseen[r["shape"]] = r["mass"], r["once"]
    unseen = np.maximum(unseen, 0.1)
    return Vocabulary(known, number, own, sums["total"] or 0, sums["distinct"], rest + unseen, unseen)


class Numbers:
    """Numbers of words, from a vocabulary known to the task."""

    def __init__(self, known: Vocabulary) -> None:
        self.number = {w: i for i, w in enumerate(known.head)}
        self.first_shape = len(known.head)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of the words and of the end token; words that aren't known have that of their shape, and
        are returned too."""
        get = self.number.get
        found = [get(w) for w in words]
        tail = [w for w, i in zip(words, found, strict=True) if i is None] if None in found else []
        if tail:
            n = self.first_shape
            found = [n + word_shape(w) if i is None else i for w, i in zip(words, found, strict=True)]
        found.append(0)
        return np.array(found, np.int64), tail


# -- training ------------------------------------------------------------------------------------


def windows(tokens: np.ndarray, chosen: int, share: int = SHARE, window: int = WINDOW) -> list[np.ndarray]:
    """Every ``share``-th window of some tokens, one at least; ``chosen`` is any number."""
    n = -(-len(tokens) // window)
    return [tokens[i * window : (i + 1) * window] for i in range(chosen % min(n, share), n, share)]


def training_windows(docs: DataFrame, known: Vocabulary, copies: int, share: int = SHARE, window: int = WINDOW) -> DataFrame:
    """copy, place (an order inside the copy) and tokens of all windows to learn from; documents are (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([("copy", pa.int64()), ("place", pa.int64()), ("tokens", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        numbers, (token, _, _) = Numbers(known), known.per_number()
        for given in batches:
            copy, place, tokens = [], [], []
            for text, h in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True):
                for i, part in enumerate(windows(token[numbers.of(lower_words(text))[0]], h >> 8, share, window)):
                    copy.append(h % copies)
                    place.append(h ^ i)
                    tokens.append(part.astype("<i4").tobytes())
            yield batch(schema, copy=copy, place=place, tokens=tokens)

    return docs.select("text", F.xxhash64("doc_id", "text").alias("h")).mapInArrow(cut, "copy long, place long, tokens binary")


def train_model(docs: DataFrame, known: Vocabulary, share: int = SHARE, window: int = WINDOW) -> gru.Arrays:
    """Parameters averaged over the copies; every copy emits what it changed, in blocks of rows."""
    shape, counts = known.shape_of_model()
    start = gru.initial(shape, counts)
    shared = docs.sparkSession.sparkContext.broadcast((known.shape_of_model()[0], start))
    copies = max(1, -(-known.total // (share * COPY)))
    names = ["name", "block", "copy", "moved", "uses"]
    kinds = "name string, block int, copy long, moved binary, uses binary"

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shape, start = shared.value
        p = {k: v.copy() for k, v in start.items()}
        squares = gru.no_squares(p)
        uses = {k: np.zeros(len(v)) for k, v in p.items()}
        texts = [np.frombuffer(t, "<i4").astype(np.int64) for t in rows.sort_values(["place", "tokens"])["tokens"]]
        ends = np.cumsum([len(t) for t in texts]) // LOT
        for cut in np.unique(ends):
            _, used = gru.train(p, shape, texts[np.searchsorted(ends, cut) : np.searchsorted(ends, cut, side="right")], 0, squares, RATE)
            for k in uses:
                uses[k] += used[k]
        out = []
        for k, v in p.items():
            for i in range(0, len(v), BLOCK):
                n = uses[k][i : i + BLOCK]
                if n.any():
                    moved = (v[i : i + BLOCK] - start[k][i : i + BLOCK]) * n[:, None]
                    out.append((k, i, key[0], moved.astype("<f4").tobytes(), n.astype("<f8").tobytes()))
        return pd.DataFrame(out, columns=names)

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("copy")
        moved = sum(np.frombuffer(m, "<f4").astype(np.float64) for m in rows["moved"])
        uses = sum(np.frombuffer(u, "<f8") for u in rows["uses"])
        return pd.DataFrame([(*key, moved.astype("<f4").tobytes(), uses.tobytes())], columns=names)

    summed = training_windows(docs, known, copies, share, window).groupBy("copy").applyInPandas(learn, kinds)
    while True:
        copies = -(-copies // ADDED)
        level = F.floor(F.col("copy") / ADDED).cast("long")
        summed = summed.withColumn("copy", level).groupBy("name", "block", "copy").applyInPandas(add, kinds)
        if copies == 1:
            break
    for r in summed.toPandas().itertuples():
        rows = slice(r.block, r.block + BLOCK)
        target, n = start[r.name], np.frombuffer(r.uses, "<f8")
        change = np.frombuffer(r.moved, "<f4").reshape(len(n), -1) / np.maximum(n, 1)[:, None]
        target[rows] += change.astype(np.float32)
    return start


# -- scores --------------------------------------------------------------------------------------


def _score(docs: DataFrame, known: Vocabulary, model: gru.Arrays) -> DataFrame:
    """Per row of (doc_id, text): row, doc_id, n_tokens, head_known, head_base, head_model, tail (words, shapes)."""
    shared = docs.sparkSession.sparkContext.broadcast((known, model))
    kind = docs.dtypes[0][1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        shape, _ = known.shape_of_model()
        numbers, (token, log_count, log_share) = Numbers(known), known.per_number()
        n_head, seen = len(known.head), np.r_[known.counts > 0, np.zeros(SHAPES, bool)]

        def lot(rows: pa.RecordBatch, texts: list[np.ndarray], tails: list[list[bytes]]) -> pa.RecordBatch:
            logs = gru.score(model, shape, [token[t] for t in texts], 0) / np.log(10)
            flat = np.concatenate(texts)
            first = np.cumsum([0, *map(len, texts[:-1])])
            words = pa.array([w for some in tails for w in some], pa.binary())
            shapes = pa.array((flat[flat >= n_head] - n_head).astype(np.int32))
            cuts = pa.array(np.cumsum([0, *map(len, tails)]).astype(np.int32))
            columns = [
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(np.add.reduceat(seen[flat].astype(np.int64), first)),
                pa.array(np.add.reduceat(log_count[flat], first)),
                pa.array(np.add.reduceat(log_share[flat], first) + logs),
                pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([words, shapes], ["word", "shape"])),
            ]
            names = ["row", "doc_id", "n_tokens", "head_known", "head_base", "head_model", "tail"]
            return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *columns], names=names)

        for given in batches:
            texts, tails, begin, held = [], [], 0, 0
            for i, text in enumerate(given.column(2).to_pylist()):
                found, tail = numbers.of(lower_words(text))
                texts.append(found)
                tails.append(tail)
                held += len(found)
                if held >= SCORED or i == given.num_rows - 1:
                    yield lot(given.slice(begin, i + 1 - begin), texts, tails)
                    texts, tails, begin, held = [], [], i + 1, 0

    kinds = f"row long, doc_id {kind}, n_tokens long, head_known long, head_base double, head_model double, tail array<struct<word: binary, shape: int>>"
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(read, kinds)


def score_documents(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score; ``train`` filters by doc_id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    learnt_from = rows if train is None else rows.filter(train)
    counts = stored(count_words(learnt_from), "lm-counts")
    known = vocabulary(counts)
    model = train_model(learnt_from, known)
    scored = stored(_score(rows, known, model), "lm-scores")

    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.shape")
    met = tail.join(counts.select("word", "c"), "word", "left")
    unseen = F.element_at(F.array(*map(F.lit, np.log10(known.unseen).tolist())), F.col("shape") + 1)
    sums = met.groupBy("row").agg(
        F.count("c").alias("tail_known"),
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("tail_base"),
        F.sum(F.coalesce(F.log10(F.col("c") + 0.1), unseen)).alias("tail_model"),
    )
    norm = float(np.log10(known.total + 0.1 * (known.distinct + 1)))
    zero = F.lit(0.0)
    return scored.drop("tail").join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("tail_base", zero) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("head_model") + F.coalesce("tail_model", zero)).alias("score"),
    )
