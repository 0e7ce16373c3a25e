"""Substring deduplication by hashing lines and the pieces of lines.

Texts are normalised (white space, case of A-Z).  Every line has a digest, and is cut into units after words
whose hash is the least of its neighbourhood in the line, so that a passage in the middle of a line is cut alike
wherever it stands.  Every two neighbouring units have one digest.  Digests are grouped over all documents;
the occurrence in the document of least rank (id, then place in the table), there the first, stays.  Other
occurrences are repeats: a repeated line goes however short it is, and where repeats of any kind cover
``min_words`` words on end, these words go.  Spans refer to the original text, which is otherwise left as it is.

Repeats within a lot of rows are found before anything is shuffled, so a digest that a third of all
documents have is shuffled once per lot.  Digests have 64 bits; two of pieces that are equal by chance can't
remove anything, since a removed run needs several.

Defined results: null stays null and empty stays empty, without spans; repeated rows are documents of
their own, of which the first keeps its text; null ids rank last; a document that is one repeat keeps an
empty text and its row; an empty table gives an empty result.  Input must be a stored table: rows are
told apart by their place in it.  Other columns of the input are kept by ``deduplicate_rows``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstats.shared import numbered

from .text import WordHashes, batch, lower_words, raw

MIN_WORDS = 30
#: A unit ends where a word's hash is the least of so many words on either side; longer units are cut.
REACH, MOST_WORDS = 2, 16
#: Units of a lot, within which repeats are found early, and units of a lot handed on at a time.
LOT, PART = 1_000_000, 1 << 17
ROW = "_llm_row"
_WORD, _SPACE = re.compile(r"[^\x20\x09-\x0D]+"), " \t\n\x0b\x0c\r"
_BASE = 0x9E3779B97F4A7C15
#: Seed of the digests of lines.
_LINE = 9
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, remembered while they are short."""
    global _powers
    found = _powers
    if len(found[0]) < n:
        grown = np.full((2, max(n, 1 << 16)), [[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
        grown[:, 0] = 1
        found = tuple(np.multiply.accumulate(grown, axis=1))
        if n <= 1 << 20:
            _powers = found
    return found


def unit_ends(hashes: np.ndarray, line_ends: np.ndarray) -> np.ndarray:
    """Ends of the units, as numbers of words; ``line_ends`` are some of them, and neighbourhoods end there too."""
    n = len(hashes)
    line = np.zeros(n, np.int64)
    line[line_ends[line_ends < n]] = 1
    line = np.cumsum(line)
    least = np.ones(n, bool)
    for k in range(1, min(REACH, n - 1) + 1):
        apart = line[k:] != line[:-k]
        least[k:] &= (hashes[k:] < hashes[:-k]) | apart
        least[:-k] &= (hashes[:-k] <= hashes[k:]) | apart
    least[line_ends - 1] = True
    least[-1] = True
    ends = np.flatnonzero(least) + 1
    if np.diff(ends, prepend=0).max() > MOST_WORDS:
        cut, begin = [], 0
        for end in ends.tolist():
            cut.extend(range(begin + MOST_WORDS, end, MOST_WORDS))
            cut.append(end)
            begin = end
        ends = np.array(cut)
    return ends


def units_of(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and digest of every two neighbouring units (or of the only one), then of every line.

    Of lines the number of words is negative.
    """
    words = lower_words(text)
    if not words:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    h = hashes.of(words)
    lines = np.fromiter((len(line.split()) for line in raw(text).split(b"\n")), np.int64)
    lines = lines[lines > 0]
    line_ends = np.cumsum(lines)
    ends = unit_ends(h, line_ends)
    power, inverse = _base_powers(len(h) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(h * power[: len(h)])]
    begins = np.r_[0, ends[:-1]]
    last = ends if len(ends) == 1 else ends[1:]
    first = begins[: len(last)]
    digest = (sums[last] - sums[first]) * inverse[first]
    digest ^= digest >> np.uint64(31)
    digest *= np.uint64(0xBF58476D1CE4E5B9)
    line_begins = line_ends - lines
    whole = (xxhash.xxh3_64_intdigest(b" ".join(words[a:b]), _LINE) for a, b in zip(line_begins.tolist(), line_ends.tolist(), strict=True))
    whole = np.fromiter(whole, np.uint64, len(lines))
    return np.r_[first, line_begins], np.r_[last - first, -lines], np.r_[digest + (last - first).astype(np.uint64), whole]


def find_units(placed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Units by row of a table with row numbers (ROW): row, doc_id, first, n, digest, known.

    ``known`` marks repeats that are certain inside a lot of rows: another one of the lot has a lesser rank.
    """
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("digest", pa.int64()), ("known", pa.bool_())]
    )

    def lot(rows: list[tuple[int, int]], parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """Units in the order of their digests, then of documents; ``parts`` is emptied, so that nothing is held twice."""
        row, doc_id = np.array(rows, np.int64).T
        by_rank = np.lexsort((row, doc_id))
        rank = np.empty(len(rows), np.int32)
        rank[by_rank] = np.arange(len(rows), dtype=np.int32)
        rank = np.repeat(rank, [len(first) for first, _, _ in parts])
        first, n, digest = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.lexsort((first, rank, digest))
        row, doc_id, last = row[by_rank], doc_id[by_rank], None
        for i in range(0, len(order), PART):
            at = order[i : i + PART]
            of, some = rank[at], digest[at]
            known = np.r_[some[0] == last, some[1:] == some[:-1]]
            last = some[-1]
            yield batch(
                schema,
                row=pa.array(row[of]),
                doc_id=pa.array(doc_id[of], mask=doc_id[of] == _LAST),
                first=pa.array(first[at]),
                n=pa.array(n[at]),
                digest=pa.array(some.view(np.int64)),
                known=pa.array(known, pa.bool_()),
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows, parts, held = WordHashes(), [], [], 0
        for given in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in given.columns), strict=True):
                first, n, digest = units_of(text, hashes)
                if len(first):
                    rows.append((row, _LAST if doc_id is None else doc_id))
                    parts.append((first.astype(np.int32), n.astype(np.int32), digest))
                    held += len(first)
                if held >= LOT:
                    yield from lot(rows, parts)
                    rows, held = [], 0
        if parts:
            yield from lot(rows, parts)

    rows = placed.select(F.col(ROW).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "row long, doc_id long, first int, n int, digest long, known boolean")


_LAST = 2**63 - 1


def repeats(units: DataFrame) -> DataFrame:
    """row and spans (first, n) of all units but the first occurrence of each digest."""
    apart = F.xxhash64("row", "first")  # known repeats need no company
    key = F.when(F.col("known"), apart).otherwise(F.col("digest"))
    rank = Window.partitionBy("key", "known").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    later = units.withColumn("key", key).withColumn("nth", F.row_number().over(rank)).filter(F.col("known") | (F.col("nth") > 1))
    return later.groupBy("row").agg(F.collect_list(F.struct("first", "n")).alias("spans"))


def removed_runs(n_words: int, first: np.ndarray, n: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Runs of words (begin, end) that the spans cover: of ``min_words`` at least, and those of whole lines (negative n)."""

    def covered(first: np.ndarray, n: np.ndarray) -> np.ndarray:
        step = np.zeros(n_words + 1, np.int64)
        np.add.at(step, first, 1)
        np.add.at(step, first + n, -1)
        return np.r_[False, np.cumsum(step[:-1]) > 0, False]

    def runs(of: np.ndarray) -> Iterator[tuple[int, int]]:
        edges = np.flatnonzero(of[1:] != of[:-1])
        return zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)

    gone = covered(first[n < 0], -n[n < 0])
    for a, b in runs(covered(first, np.abs(n))):
        if b - a >= min_words:
            gone[a + 1 : b + 1] = True
    return list(runs(gone))


def without(text: str, spans: list[dict[str, int]], min_words: int) -> tuple[str, list[tuple[int, int]], int]:
    """The text without its long repeats, their offsets in code points, and how many words went."""
    places = [m.span() for m in _WORD.finditer(text)]
    first, n = (np.array([s[k] for s in spans], np.int64) for k in ("first", "n"))
    kept, offsets, at, gone, b = [], [], 0, 0, 0
    for a, b in removed_runs(len(places), first, n, min_words):
        begin, end = places[a][0], places[b - 1][1]
        kept.append(text[at:begin])
        at = places[b][0] if b < len(places) else len(text)
        offsets.append((begin, end))
        gone += b - a
    if not offsets:
        return text, [], 0
    left = "".join([*kept, text[at:]])
    return left.rstrip(_SPACE) if b == len(places) else left, offsets, gone


def deduplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with their text cut; added: _llm_removed (offsets) and _llm_gone (words)."""
    placed = numbered(docs, ROW)
    found = repeats(find_units(placed, id_col, text_col))
    joined = placed.join(found.select(F.col("row").alias(ROW), F.col("spans").alias("_llm_spans")), ROW, "left").drop(ROW)
    names = docs.columns
    place = names.index(text_col)
    offsets = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            texts, removed, gone = [], [], []
            for text, spans in zip(given.column(place).to_pylist(), given.column(len(names)).to_pylist(), strict=True):
                text, some, n = without(text, spans, min_words) if spans else (text, [], 0)
                texts.append(text)
                removed.append([{"begin": a, "end": b} for a, b in some])
                gone.append(n)
            columns = [pa.array(texts, pa.string()) if i == place else given.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(removed, offsets), pa.array(gone, pa.int32())], names=[*names, "_llm_removed", "_llm_gone"]
            )

    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return joined.mapInArrow(cut, f"{kinds}, _llm_removed array<struct<begin: int, end: int>>, _llm_gone int")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: doc_id, text, removed (begin and end offsets in the original text), n_removed_words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cut = deduplicate_rows(rows, "doc_id", "text", min_words)
    return cut.withColumnsRenamed({"_llm_removed": "removed", "_llm_gone": "n_removed_words"})
