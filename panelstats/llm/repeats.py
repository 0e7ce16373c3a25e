"""Removal of repeated byte strings by a suffix array over sampled suffixes, sorted deep-shallow.

Texts are UTF-8 bytes.  A string of ``length`` bytes repeats if it also starts earlier: in a document of lesser rank
(id, then place in the table), or there at a lesser start.  Every byte that a repeat covers goes.

Not all suffixes need to be sorted for that.  A string holds ``length - gram + 1`` grams, and the one with the least
hash is its anchor, so equal strings have equal anchors at equal offsets.  Anchors are about a thirtieth of all
places.  They are dealt by gram and by context (all bytes that a string with this anchor can have):

1. Of anchors with equal contexts all but the first are whole repeats.  Within a lot of documents that is seen
   before anything is shuffled, so a copied passage is shuffled once per lot.
2. A gram that has one context is done.  Grams with several contexts get their bytes, and the suffixes that begin at
   them are sorted by multikey quicksort to a shallow depth and by blind tries beyond it; likewise the reversed
   prefixes before them.  What neighbours share tells for every depth which contexts agree so far, and a string is
   given by its offset and by how far its context must agree to the left and to the right.
3. A gram with more than ``most`` contexts would be a large group.  Its strings are taken one by one instead: the
   first place of each digest (of 128 bits) is an aggregate that Spark combines early.

Anchors are range-partitioned by gram and context, so that a frequent gram is split over tasks.  Texts travel
compressed.

Defined results: a null text is empty, and of an empty or short text nothing is removed; repeated rows are documents
of their own, of which the first keeps its bytes; null ids rank last; an empty table gives an empty result.  Bytes
that are left may be no UTF-8, so they are returned as bytes.  Input must be a stored table: rows are told apart by
their place in it.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats.shared import numbered, stored

from .suffixes import SHALLOW, agreement, classes_by_depth, deep_shallow
from .text import batch, raw

LENGTH, GRAM = 100, 36
#: Contexts of a gram that are sorted together at most.
MOST = 8192
#: Anchors of a lot, within which equal contexts are found early; contexts sorted at a time; bytes hashed at a time.
LOT, SORTED, PART = 300_000, 4096, 1 << 20
ROW = "_llm_row"
_LAST = 2**63 - 1
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(12).integers(0, 2**64, 256, np.uint64, endpoint=False)
_POWER = np.multiply.accumulate(np.r_[np.uint64(1), np.full(PART, _BASE, np.uint64)])
_INVERSE = np.multiply.accumulate(np.r_[np.uint64(1), np.full(PART, pow(_BASE, -1, 1 << 64), np.uint64)])


# -- anchors -------------------------------------------------------------------------------------


def _part_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a part of at most PART bytes: place and hash of the gram."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * _POWER[:n], out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * _INVERSE[: n - gram + 1]
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(29)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)  # ties: the first
    window, have = length - gram + 1, 1
    while have < window:
        step = min(have, window - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]]
    return at, hashes[at]


def anchors_of(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all strings of ``length`` bytes in a text, and the hashes of their grams."""
    if len(text) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    data = np.frombuffer(text, np.uint8)
    if len(data) <= PART:
        return _part_anchors(data, length, gram)
    found = [(at + i, h) for i in range(0, len(data) - length + 1, PART - length) for at, h in [_part_anchors(data[i : i + PART], length, gram)]]
    at, first = np.unique(np.concatenate([at for at, _ in found]), return_index=True)
    return at, np.concatenate([h for _, h in found])[first]


def merge_spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of some spans."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.r_[True, begin[1:] > end[:-1]]
    return begin[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]


_MET = [("gram", pa.int64()), ("ctx", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("end", pa.int32()), ("span", pa.bool_())]


def find_anchors(placed: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Anchors of a table with row numbers, of equal contexts in a lot only the first; the others' spans.

    ``at`` is the gram's place and ``end`` that of its context; of a span they are the bounds.
    """
    schema, side = pa.schema(_MET), length - gram

    def lot(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        gram_hash, ctx, doc_id, row, at, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, row, doc_id, ctx, gram_hash))
        gram_hash, ctx, doc_id, row, at, end = (x[order] for x in (gram_hash, ctx, doc_id, row, at, end))
        known = np.r_[False, (gram_hash[1:] == gram_hash[:-1]) & (ctx[1:] == ctx[:-1])]
        if known.any():
            begin = at[known] - np.minimum(at[known], side)
            yield _spans(schema, *_merged_by_row(row[known], begin, end[known]))
        use = ~known
        yield batch(
            schema,
            gram=gram_hash[use].view(np.int64),
            ctx=ctx[use].view(np.int64),
            doc_id=pa.array(doc_id[use], mask=doc_id[use] == _LAST),
            row=row[use],
            at=at[use].astype(np.int32),
            end=end[use].astype(np.int32),
            span=np.zeros(int(use.sum()), bool),
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for given in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in given.columns), strict=True):
                data = raw(text)
                at, hashes = anchors_of(data, length, gram)
                if not len(at):
                    continue
                end = np.minimum(at + length, len(data))
                begin = at - np.minimum(at, side)
                ctx = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(at))
                ctx ^= (at - begin).astype(np.uint64) * np.uint64(_BASE)  # how far it reaches on either side
                rank = _LAST if doc_id is None else doc_id
                parts.append((hashes, ctx, np.full(len(at), rank), np.full(len(at), row), at, end))
                held += len(at)
                if held >= LOT:
                    yield from lot(parts)
                    parts, held = [], 0
        if parts:
            yield from lot(parts)

    rows = placed.select(F.col(ROW).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(read, "gram long, ctx long, doc_id long, row long, at int, end int, span boolean")


def _merged_by_row(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of spans of several rows."""
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order].astype(np.int64), end[order].astype(np.int64)
    place = np.cumsum(np.r_[True, row[1:] != row[:-1]]) << 33  # rows side by side, so that their spans can't touch
    begin, end = merge_spans(begin + place, end + place)
    which = np.searchsorted(place, (begin >> 33) << 33)
    return row[which], begin & ((1 << 33) - 1), end & ((1 << 33) - 1)


def _spans(schema: pa.Schema, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Spans as rows of ``_MET``; where they go doesn't matter, so they are dealt by their place."""
    deal = (row.view(np.uint64) * np.uint64(_BASE)) ^ (begin.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    none = np.zeros(len(row), np.int64)
    return batch(schema, gram=deal.view(np.int64), ctx=none, doc_id=none, row=row, at=begin.astype(np.int32), end=end.astype(np.int32), span=np.ones(len(row), bool))


def meet(found: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Spans of all but the first anchor of each context, and the first ones of grams with several contexts."""
    schema, side = pa.schema(_MET), length - gram
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["span", "gram", "ctx", F.col("doc_id").asc_nulls_last(), "row", "at"]
    dealt = found.repartitionByRange(parts, "gram", "ctx").sortWithinPartitions(*order)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None  # the last first of a context, and the last row's gram and context
        edge = True  # the first gram may have begun in another partition
        for given in batches:
            span = np.asarray(given.column("span"))
            if span.any():
                yield given.filter(given.column("span"))
                given = given.filter(pa.array(~span))
            if not given.num_rows:
                continue
            g, c = (given.column(n).to_numpy() for n in ("gram", "ctx"))
            first = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])]
            first[0] = before != (g[0], c[0])
            before = (g[-1], c[-1])
            if not first.all():
                at, end = (given.column(n).to_numpy()[~first].astype(np.int64) for n in ("at", "end"))
                yield _spans(schema, given.column("row").to_numpy()[~first], at - np.minimum(at, side), end)
            firsts = pa.Table.from_batches([given.filter(pa.array(first))])
            if held is not None:
                firsts = pa.concat_tables([held, firsts])
            if not firsts.num_rows:
                continue
            g = firsts.column("gram").to_numpy()
            again = g[1:] == g[:-1]
            several = np.r_[edge, again] | np.r_[again, False]
            yield from firsts.slice(0, len(g) - 1).filter(pa.array(several[:-1])).combine_chunks().to_batches()
            held, edge = firsts.slice(len(g) - 1), bool(several[-1])
        if held is not None:
            yield from held.combine_chunks().to_batches()  # the last gram may go on in another partition

    return dealt.mapInArrow(read, "gram long, ctx long, doc_id long, row long, at int, end int, span boolean")


# -- contexts ------------------------------------------------------------------------------------


def packed_texts(placed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, and the text's bytes: compressed, and how many."""
    kind = placed.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for given in batches:
            some = [raw(t) for t in given.column(2).to_pylist()]
            data = pa.array([codec.compress(t, asbytes=True) if t else b"" for t in some], pa.binary())
            yield pa.RecordBatch.from_arrays([given.column(0), given.column(1), data, pa.array(map(len, some), pa.int64())], names=["row", "doc_id", "data", "n"])

    return placed.select(F.col(ROW).alias("row"), F.col(id_col), F.col(text_col)).mapInArrow(pack, f"row long, doc_id {kind}, data binary, n long")


def _contexts(firsts: DataFrame, texts: DataFrame, most: int, length: int, gram: int) -> DataFrame:
    """Bytes around the anchors: key, doc_id, row, at, left (reversed), n_left, right, n_right, hot.

    Both sides are filled up with zeros.
    """
    side = length - gram
    frequent = firsts.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("gram", F.lit(True).alias("hot"))
    marked = firsts.join(frequent, "gram", "left").select("row", "doc_id", F.struct("gram", "at", F.coalesce("hot", F.lit(False)).alias("hot")).alias("anchor"))
    by_row = marked.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list("anchor").alias("anchors"))
    schema = pa.schema(
        [("key", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("left", pa.binary()), ("n_left", pa.int32()), ("right", pa.binary()), ("n_right", pa.int32()), ("hot", pa.bool_())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for given in batches:
            out: list[tuple] = []
            for row, doc_id, anchors, data, n in zip(*(c.to_pylist() for c in given.columns), strict=True):
                text = codec.decompress(data, n, asbytes=True)
                for a in anchors:
                    at = a["at"]
                    left, right = text[max(0, at - side) : at], text[at : at + length]
                    out.append((a["gram"], doc_id, row, at, left[::-1].ljust(side, b"\0"), len(left), right.ljust(length, b"\0"), len(right) - gram, a["hot"]))
                    if len(out) == SORTED:
                        yield batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))
                        out = []
            if out:
                yield batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))

    joined = by_row.join(texts.drop("doc_id"), "row").select("row", "doc_id", "anchors", "data", "n")
    return joined.mapInArrow(cut, "key long, doc_id long, row long, at int, left binary, n_left int, right binary, n_right int, hot boolean")


def repeated_offsets(
    groups: np.ndarray, left: list[bytes], n_left: np.ndarray, right: list[bytes], n_right: np.ndarray, length: int = LENGTH, gram: int = GRAM
) -> np.ndarray:
    """Which strings repeat, by context (column, in order of rank inside its group) and bytes left of the anchor (row).

    Contexts of a group stand together; ``groups`` are the first places of the groups.
    """
    side, ends = length - gram, np.r_[groups[1:], len(left)]
    orders, shared = ([], []), ([], [])
    for a, b in zip(groups.tolist(), ends.tolist(), strict=True):
        alike = len({s[:gram] for s in right[a:b]}) == 1
        for i, (strings, depth) in enumerate(((left, 0), (right, gram if alike else 0))):
            order = deep_shallow(strings, list(range(a, b)), depth, depth + SHALLOW)
            orders[i].append(order)
            shared[i].append(agreement(strings, order))
    offset = np.arange(side + 1)
    sides = [classes_by_depth(np.concatenate(orders[i]), np.concatenate(shared[i]), depth) for i, depth in enumerate((offset, length - offset))]
    key = (sides[0].astype(np.int64) << 32 | sides[1]).T
    usable = (offset[:, None] <= n_left) & (side - offset[:, None] <= n_right)
    key = np.where(usable, key, -1 - np.arange(len(left)))
    order = np.argsort(key, axis=1, kind="stable")
    ranked = np.take_along_axis(key, order, axis=1)
    again = np.zeros(key.shape, bool)
    np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], axis=1)
    return again & usable


def sorted_spans(contexts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """row, begin, end of the repeats among the contexts of each gram."""
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.repartition(parts, "key").sortWithinPartitions("key", F.col("doc_id").asc_nulls_last(), "row", "at")
    schema = pa.schema([("row", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])

    def lot(given: pa.Table) -> pa.RecordBatch:
        key, row, at, n_left, n_right = (given.column(n).to_numpy() for n in ("key", "row", "at", "n_left", "n_right"))
        groups = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        left, right = (given.column(n).to_pylist() for n in ("left", "right"))
        again = repeated_offsets(groups, left, n_left, right, n_right, length, gram).T
        step = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (which, low), (_, high) = np.nonzero(step == 1), np.nonzero(step == -1)
        row, begin, end = _merged_by_row(row[which], at[which] - (high - 1), at[which] - low + length)
        return batch(schema, row=row, begin=begin.astype(np.int32), end=end.astype(np.int32))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for given in batches:
            now = pa.Table.from_batches([given])
            held = now if held is None else pa.concat_tables([held, now])
            if held.num_rows >= SORTED:
                key = held.column("key").to_numpy()
                whole = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if whole:
                    yield lot(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield lot(held)

    return dealt.mapInArrow(read, "row long, begin int, end int")


def single_spans(contexts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The same, string by string: all but the first place of each digest."""
    side = length - gram
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int32())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for i in range(0, given.num_rows, 1000):
                out: list[tuple] = []
                for r in given.slice(i, 1000).to_pylist():
                    whole = r["left"][: r["n_left"]][::-1] + r["right"][: gram + r["n_right"]]
                    for at in range(len(whole) - length + 1):
                        digest = xxhash.xxh3_128_digest(whole[at : at + length])
                        halves = (int.from_bytes(half, signed=True) for half in (digest[:8], digest[8:]))
                        out.append((*halves, r["doc_id"], r["row"], r["at"] - r["n_left"] + at))
                if out:
                    yield batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))

    strings = contexts.select("doc_id", "row", "at", "left", "n_left", "right", "n_right").mapInArrow(each, "high long, low long, doc_id long, row long, at int")
    strings = stored(strings, "repeats-strings")
    rank = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "row", "at")
    firsts = strings.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = strings.join(firsts, ["high", "low"]).filter((F.col("row") != F.col("first.row")) | (F.col("at") != F.col("first.at")))
    return later.select("row", F.col("at").alias("begin"), (F.col("at") + length).cast("int").alias("end"))


# -- result --------------------------------------------------------------------------------------


def repeat_spans(placed: DataFrame, texts: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """row, begin, end of spans whose union is what goes, of a table with row numbers."""
    met = stored(meet(find_anchors(placed, id_col, text_col, length, gram), length, gram), "repeats-met")
    spans = met.filter("span").select("row", F.col("at").alias("begin"), "end")
    contexts = stored(_contexts(met.filter("not span"), texts, most, length, gram), "repeats-contexts")
    spans = spans.union(sorted_spans(contexts.filter("not hot"), length, gram))
    hot = contexts.filter("hot")
    return spans if hot.isEmpty() else spans.union(single_spans(hot, length, gram))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST
) -> DataFrame:
    """Per row: doc_id, kept (the bytes that are left), n_bytes, removed (begin and end of the runs of bytes that went)."""
    if not 0 < gram < length:
        raise ValueError("a gram is shorter than the strings")
    placed = numbered(docs.select(id_col, text_col), ROW)
    texts = packed_texts(placed, id_col, text_col)
    spans = repeat_spans(placed, texts, id_col, text_col, length, gram, most)
    by_row = spans.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        runs = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for given in batches:
            kept, removed = [], []
            for data, n, some in zip(*(c.to_pylist() for c in given.columns[1:]), strict=True):
                text = codec.decompress(data, n, asbytes=True) if n else b""
                begin, end = (np.array([s[k] for s in some or []], np.int64) for k in ("begin", "end"))
                begin, end = (x.tolist() for x in merge_spans(begin, end))
                kept.append(b"".join(text[a:b] for a, b in zip([0, *end], [*begin, n], strict=True)))
                removed.append([{"begin": a, "end": b} for a, b in zip(begin, end, strict=True)])
            columns = [given.column(0), pa.array(kept, pa.binary()), given.column(2), pa.array(removed, runs)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "kept", "n_bytes", "removed"])

    joined = texts.join(by_row, "row", "left").select("doc_id", "data", "n", "spans")
    return joined.mapInArrow(cut, f"doc_id {kind}, kept binary, n_bytes long, removed array<struct<begin: bigint, end: bigint>>")


def repeats_sql(length: int = LENGTH) -> str:
    """The query's rows in SQL; bytes are pairs of hexadecimal digits."""
    return f"""
        with given as (select doc_id, hex(encode(coalesce(text, ''))) digits from documents),
        strings as (
          select doc_id, pos, row_number() over (partition by s order by doc_id, pos) nth
          from (select doc_id, pos, substring(digits, 2 * pos + 1, {2 * length}) s
                from (select *, unnest(range(0, strlen(digits) // 2 - {length - 1})) pos from given))),
        repeated as (
          select doc_id, pos, coalesce(pos > {length} + lag(pos) over (partition by doc_id order by pos), true) new
          from strings where nth > 1),
        runs as (
          select doc_id, min(pos) low, max(pos) + {length} high
          from (select *, sum(new::int) over (partition by doc_id order by pos) run from repeated) group by doc_id, run),
        pieces as (
          select doc_id, low, high, coalesce(lag(high) over (partition by doc_id order by low), 0) start from runs),
        cut as (
          select doc_id, sum(high - low) gone, count(*) n, max(high) last,
                 string_agg(substring(digits, 2 * start + 1, 2 * (low - start)), '' order by low) kept
          from pieces join given using (doc_id) group by doc_id)
        select g.doc_id, cast(strlen(digits) // 2 as bigint) n_bytes, cast(coalesce(gone, 0) as bigint) n_removed,
               cast(coalesce(n, 0) as bigint) n_spans,
               sha256(unhex(coalesce(kept, '') || substring(digits, 2 * coalesce(last, 0) + 1))) kept_sha256
        from given g left join cut c on g.doc_id = c.doc_id
    """
