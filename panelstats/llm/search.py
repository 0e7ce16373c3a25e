"""Ranked lexical search with per-term geometric blocking.

Every item's terms are searched in all documents.  A document's score is a sum of integer contributions of the terms
it shares with the item; a term's contribution depends on how often the document has it and on its length.

Documents are indexed in lots.  In a lot each term has a posting list, which is cut into blocks of similar documents:
some of its documents stand for the blocks, and each other one joins the one whose direction (contributions projected
on a few random axes) is most like its own.  A block's summary is the coordinatewise maximum of its documents'
contributions, so the sum of a summary over an item's terms is an exact upper bound of every score in the block.

Terms are taken from the rarest to the most frequent.  A document with a rarer term of the item was decided when that
term's list was, so a list's bounds count its own term and more frequent ones only.  A list, and then a block, is
skipped only if its bound is under the score of the item's kth best so far; documents of the other blocks are scored
in full, best bounds first.  Every task keeps a heap per item, and heaps are merged by item.  A first search over
about ``SAMPLE`` documents finds scores that the best of all documents can't be under; it decides nothing else.

Nothing is shuffled but the heaps.  Items are searched for in chunks of about ``TERMS`` terms, so what a task knows
of them is bounded; a larger set of items takes more passes over the documents.

Defined results: null and empty texts have no terms, and items without terms no rows; items that repeat count once;
equal ids with other terms are items of their own; repeated documents are ranked each for itself; null document ids
come last among equals; an empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstats.shared import stored

from .heaps import Heaps, merged
from .text import batch, raw

BEST = 50
#: Terms of a chunk of items, documents of the first search, documents and postings of a lot.
TERMS, SAMPLE, DOCS, POSTINGS = 1 << 17, 4096, 8192, 600_000
#: Documents of a block about, axes that similarity is measured on, cells of summaries made at a time.
BLOCK, AXES, CELLS = 32, 16, 1 << 20
_LAST = 2**63 - 1
#: Bytes of terms (digits, letters, everything beyond ASCII), A-Z lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a whole text, in order."""
    return raw(text).translate(_FOLD).split()


# -- items and documents -------------------------------------------------------------------------


@dataclass
class Chunk:
    """Items of a chunk: their ids, and their terms as numbers, ascending; terms are numbered in order."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: list[bytes]


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id and its distinct terms, sorted; repeated items once."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            terms = pa.array([sorted(set(terms_of(t))) for t in given.column(1).to_pylist()], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([given.column(0), terms], names=["item_id", "terms"])

    return rows.mapInArrow(read, f"item_id {rows.dtypes[0][1]}, terms array<binary>").filter(F.size("terms") > 0).distinct()


def _chunk(rows: DataFrame) -> Chunk:
    """The items of a chunk on the driver: about ``TERMS`` terms in all."""
    found = sorted(((r["item_id"], [bytes(t) for t in r["terms"]]) for r in rows.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vocabulary = sorted(set().union(*(t for _, t in found)))
    number = {t: i for i, t in enumerate(vocabulary)}
    return Chunk([i for i, _ in found], [np.array([number[t] for t in terms], np.int64) for _, terms in found], vocabulary)


def term_rows(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """Per document: doc_id, n (terms with repeats), and the numbers and counts of the vocabulary's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        for given in batches:
            n, terms, counts = [], [], []
            for text in given.column(1).to_pylist():
                words = terms_of(text)
                found = Counter(filter(number.__contains__, words))
                n.append(len(words))
                terms.append(np.fromiter(map(number.__getitem__, found), "<i4", len(found)).tobytes())
                counts.append(np.fromiter(found.values(), "<i8", len(found)).tobytes())
            yield batch(schema, doc_id=given.column(0), n=n, terms=terms, counts=counts)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(read, "doc_id long, n long, terms binary, counts binary")


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """How many documents have each term of the vocabulary."""
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for given in batches:
            found += np.bincount(np.frombuffer(b"".join(given.column(0).to_pylist()), "<i4"), minlength=size)
        met = np.flatnonzero(found)
        if len(met):
            yield batch(schema, term=met.astype(np.int32), df=found[met])

    df = np.zeros(size, np.int64)
    counted = rows.select("terms").mapInArrow(count, "term int, df long")
    for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each term at most
        df[r["term"]] = r["df"]
    return df


# -- index of a lot ------------------------------------------------------------------------------


@dataclass
class Statistics:
    """Of all documents: how many have terms, all their terms, and documents by term."""

    documents: int
    length: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * n + 1))) for n in self.df.tolist()], np.int64)

    def norm(self, n: int) -> int:
        return 50 + 50 * n * self.documents // self.length


class Lot:
    """Some documents' contributions by row: terms ascend by rank (the rarest first) within a row."""

    def __init__(self, doc_id: np.ndarray, begin: np.ndarray, term: np.ndarray, gain: np.ndarray, size: int) -> None:
        self.doc_id, self.begin, self.term, self.gain, self.size = doc_id, begin, term, gain, size
        self.doc = np.repeat(np.arange(len(doc_id)), np.diff(begin))
        self.most = np.zeros(size, np.int64)  # the summary of the whole lot
        np.maximum.at(self.most, term, gain)

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whole scores of some documents; ``wanted`` marks the item's terms."""
        at = _ranges(self.begin[docs], self.begin[docs + 1])
        sums = np.r_[0, np.cumsum(self.gain[at] * wanted[self.term[at]])]
        ends = np.cumsum(self.begin[docs + 1] - self.begin[docs])
        return sums[ends] - sums[np.r_[0, ends[:-1]]]


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of some ranges, one after the other."""
    n = end - begin
    total = np.cumsum(n)
    return np.arange(total[-1] if len(n) else 0) + np.repeat(begin - np.r_[0, total[:-1]], n)


class Blocks:
    """Posting lists of some terms, each cut into blocks of similar documents, with summaries by term."""

    def __init__(self, lot: Lot, terms: np.ndarray, block: int = BLOCK, axes: int = AXES) -> None:
        use = np.zeros(lot.size, bool)
        use[terms] = True
        posting = np.flatnonzero(use[lot.term])
        posting = posting[np.argsort(lot.term[posting], kind="stable")]
        list_of, doc = lot.term[posting], lot.doc[posting]
        cuts = np.flatnonzero(np.r_[True, list_of[1:] != list_of[:-1]]) if len(posting) else np.empty(0, np.int64)
        ends = np.r_[cuts[1:], len(posting)]
        direction = _directions(lot, axes)
        number, made = np.empty(len(posting), np.int64), 0
        for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
            if b - a <= block:
                number[a:b] = made
                made += 1
                continue
            mine = direction[doc[a:b]]
            centres = mine[:: block]
            number[a:b] = made + np.argmax(mine @ centres.T, axis=1)
            made += len(centres)
        order = np.argsort(number, kind="stable")
        posting, number = posting[order], number[order]
        new = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.empty(0, np.int64)
        self.begin = np.r_[new, len(posting)]
        self.term, self.doc = lot.term[posting[new]], lot.doc[posting]
        self._summaries(lot, posting)

    def _summaries(self, lot: Lot, posting: np.ndarray) -> None:
        """(block, maximum) by term, of the block's own term and those of greater rank."""
        n, step = len(self.term), max(1, CELLS // lot.size)
        found = []
        for i in range(0, n, step):
            j = min(n, i + step)
            some = posting[self.begin[i] : self.begin[j]]
            block = np.repeat(np.arange(j - i), np.diff(self.begin[i : j + 1]))
            ends = lot.begin[lot.doc[some] + 1]
            at = _ranges(some, ends)
            cells = np.zeros((j - i) * lot.size, np.int64)
            np.maximum.at(cells, np.repeat(block, ends - some) * lot.size + lot.term[at], lot.gain[at])
            full = np.flatnonzero(cells)
            found.append((full % lot.size, full // lot.size + i, cells[full]))
        term, block, most = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        order = np.argsort(term, kind="stable")
        self.block, self.most = block[order], most[order]
        self.of = np.searchsorted(term[order], np.arange(lot.size + 1))

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """The sum of each block's summary over an item's terms."""
        out = np.zeros(len(self.term), np.int64)
        for t in terms.tolist():
            a, b = self.of[t], self.of[t + 1]
            out[self.block[a:b]] += self.most[a:b]
        return out


def _directions(lot: Lot, axes: int) -> np.ndarray:
    """Contributions of each document on a few random axes, of length one."""
    signs = np.random.default_rng(13).choice(np.array([-1, 1], np.float32), (lot.size, axes))
    out = np.zeros((len(lot.doc_id), axes), np.float32)
    full = np.flatnonzero(np.diff(lot.begin))
    if len(full):
        out[full] = np.add.reduceat(signs[lot.term] * lot.gain[:, None].astype(np.float32), lot.begin[full], axis=0)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)


def search_lot(lot: Lot, items: list[np.ndarray], heaps: Heaps) -> int:
    """Offer the lot's documents to the items' heaps (terms by rank); returns how many were scored."""
    ends = [np.cumsum(lot.most[terms][::-1])[::-1] for terms in items]  # bounds of lists by rank
    needed = [terms[: int(np.searchsorted(-bound, -heaps.least[i], side="right"))] for i, (terms, bound) in enumerate(zip(items, ends, strict=True))]
    if not any(map(len, needed)):
        return 0
    blocks, scored = Blocks(lot, np.unique(np.concatenate(needed))), 0
    for i, (terms, lists) in enumerate(zip(items, needed, strict=True)):
        if not len(lists):
            continue
        wanted = np.zeros(lot.size, np.int64)
        wanted[terms] = 1
        bound = blocks.bounds(terms)
        mine = np.flatnonzero(np.isin(blocks.term, lists))
        mine = mine[bound[mine] >= heaps.least[i]]
        mine = mine[np.argsort(-bound[mine], kind="stable")]
        seen, at, size = np.zeros(len(lot.doc_id), bool), 0, 4
        while at < len(mine) and bound[mine[at]] >= heaps.least[i]:
            some = mine[at : at + size]
            some = some[bound[some] >= heaps.least[i]]
            docs = np.unique(blocks.doc[_ranges(blocks.begin[some], blocks.begin[some + 1])])
            docs = docs[~seen[docs]]
            seen[docs] = True
            scored += len(docs)
            score = lot.scores(docs, wanted)
            good = score >= heaps.least[i]
            heaps.push(np.full(int(good.sum()), i), score[good], lot.doc_id[docs[good]])
            at, size = at + size, 2 * size
    return scored


# -- search --------------------------------------------------------------------------------------


def ranked_rows(rows: DataFrame, chunk: Chunk, known: Statistics, least: np.ndarray, best: int, id_kind: str) -> DataFrame:
    """q (the item's number), item_id, doc_id, score, part: every task's best documents of each item."""
    rank = np.empty(len(known.df), np.int64)
    order = np.argsort(known.df, kind="stable")
    rank[order] = np.arange(len(order))
    shared = rows.sparkSession.sparkContext.broadcast((chunk, known, least, rank))
    schema = pa.schema([("q", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64()), ("part", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, known, least, rank = shared.value
        weight = known.weights()
        items = [np.sort(rank[t]) for t in chunk.terms]
        heaps = Heaps(len(items), best, once=False)
        heaps.least = least.copy()
        held: list[tuple] = []

        def search() -> None:
            doc_id, norm, term, count = zip(*held, strict=True)
            n = np.fromiter(map(len, term), np.int64, len(term))
            term, count = np.concatenate(term), np.concatenate(count)
            gain = weight[term] * (1_000_000_000 * count // (1000 * count + 20 * np.repeat(np.array(norm, np.int64), n)))
            place = np.lexsort((rank[term], np.repeat(np.arange(len(n)), n)))
            search_lot(Lot(np.array(doc_id, np.int64), np.r_[0, np.cumsum(n)], rank[term][place], gain[place], len(rank)), items, heaps)

        postings = 0
        for given in batches:
            for doc_id, n, terms, counts in zip(*(c.to_pylist() for c in given.columns), strict=True):
                if not terms:
                    continue
                held.append((_LAST if doc_id is None else doc_id, known.norm(n), np.frombuffer(terms, "<i4"), np.frombuffer(counts, "<i8")))
                postings += len(terms) // 4
                if len(held) == DOCS or postings >= POSTINGS:
                    search()
                    held.clear()
                    postings = 0
        if held:
            search()
        part = np.full(len(heaps.key), TaskContext.get().partitionId())
        doc_id = pa.array(heaps.id, mask=heaps.id == _LAST)
        yield batch(schema, q=heaps.key.astype(np.int32), doc_id=doc_id, score=heaps.score, part=part)

    return rows.select("doc_id", "n", "terms", "counts").mapInArrow(read, "q int, doc_id long, score long, part long")


def _best(found: DataFrame, best: int) -> DataFrame:
    """The best of all tasks' heaps: q, doc_id, score."""
    heaps = stored(found, "search-heaps")
    parts = (heaps.agg(F.max("part")).first()[0] or 0) + 1
    return merged(heaps, ["q"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], best, "part", parts, once=False)


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", best: int = BEST, terms: int = TERMS
) -> DataFrame:
    """Per item its ``best`` documents with a score above 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    asked = stored(item_terms(items, item_col, item_text), "search-items")
    chunks = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // terms))
    kind = asked.dtypes[0][1]
    found = []
    for i in range(chunks):
        chunk = _chunk(asked.filter(F.pmod(F.xxhash64("terms"), F.lit(chunks)) == i))
        if not chunk.ids:
            continue
        rows = stored(term_rows(docs, chunk.vocabulary, id_col, text_col), "search-rows")
        n = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
        if not n["length"]:
            continue
        known = Statistics(n["documents"], n["length"], frequencies(rows, len(chunk.vocabulary)))
        least = np.ones(len(chunk.ids), np.int64)
        few = rows.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(1 << 30)) < (1 << 30) * SAMPLE // n["rows"])
        kth = _best(ranked_rows(few, chunk, known, least, best, kind), best).groupBy("q").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
        for r in kth.filter(F.col("n") == best).collect():  # a row for each item of the chunk at most
            least[r["q"]] = r["kth"]
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        placed = _best(ranked_rows(rows, chunk, known, least, best, kind), best).withColumn("rank", place)
        names = spark.createDataFrame(list(enumerate(chunk.ids)), f"q int, item_id {kind}")
        found.append(placed.join(names, "q").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, found)


def search_sql(best: int = BEST) -> str:
    """The query's rows in SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '{_PATTERN}')"
    return f"""
        with given as (select row_number() over () r, doc_id, coalesce({terms}, []) terms from documents),
        known as (select count(*) n_docs, sum(len(terms)) total from given where len(terms) > 0),
        counted as materialized (
          select r, doc_id, len(terms) n, term, count(*) tf
          from (select *, unnest(terms) term from given) group by all),
        asked as (select distinct item_id, term from (select item_id, unnest({terms}) term from benchmark)),
        weights as (
          select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) w
          from (select term, count(*) df from counted group by term), known),
        scored as (
          select item_id, r, doc_id,
                 cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total)))) as bigint) score
          from asked join counted using (term) join weights using (term), known group by all)
        select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) "rank", doc_id, score
        from scored where score > 0
        qualify "rank" <= {best}
    """
