"""Near-duplicates by the Jaccard similarity of word shingles, with candidates from the SimHash index.

Texts link if their sets of ``SHINGLE``-word shingles have a similarity of ``SIMILAR`` at least; linked texts form
classes.  A text's fingerprint has a bit where over half of its shingles' hashes have it.  Candidates are texts that
meet in an upper node of the Gray-order index (``simhash``), differ in at most ``DISTANCE`` bits, and whose sketches
of 64 bits (one bit of each min-hash) don't show them to be less similar: fingerprints of unlike texts are that near now and
then, which would make candidates that grow with the square of the texts.  Unlike there, a wide distance can't be covered by masks that miss nothing, so random masks of a few bits are used, as many as a
pair at ``SIMILAR`` asks for to meet with a probability of ``RECALL``; they have more bits for more texts, which
keeps upper nodes small.  Every link is checked on the sets themselves.

Equal sets are one row of all that follows.  First every text is checked against three of its candidates: the nearest
one, the one whose key is the least, and the one that has most candidates itself; the last two are the same ones for
most of a large group of copies, and the last is what its copies were made of rather than one of them.  Then texts that have candidates are indexed again, and each is checked against the next
``PARTNERS`` of them that it isn't linked with yet, the nearest first, until there are none.  Min-hashes of a byte sort out pairs far under the threshold before any text travels.

Defined results: null, empty and blank texts have the empty set, and are one class; fewer words than a shingle
make one shingle; an empty table gives an empty result.  Only the named columns are read; names that begin with
``_llm_`` are reserved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstats.shared import numbered, stored

from .components import components
from .simhash import lower_nodes, node_pairs
from .text import WordHashes, batch, lower_words, raw

SHINGLE = 5
SIMILAR = Fraction(4, 5)
#: Bits that candidates differ in at most, and the probability that a pair at the threshold is one.
DISTANCE, RECALL = 18, 0.95
#: Bits of a mask at least and at most; a mask's patterns are to be about a sixty-fourth of the texts.
BITS, MOST_BITS, CROWD = 12, 16, 6
#: Bytes of a sketch, and the share of them that a pair worth checking has in common.
MINS, LIKELY = 64, 0.6
#: The probability that the sketch of a pair at the threshold keeps it from being a candidate.
LOST = 5e-5
#: Candidates that a text is checked against in a round; shingles hashed at a time.
PARTNERS, PART = 1024, 200_000
_ROW = "_llm_row"
_FAR = 255
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_random = np.random.default_rng(5)
_FACTORS = _random.integers(0, 2**64, MINS, np.uint64, endpoint=False) | np.uint64(1)
_ADDED = _random.integers(0, 2**64, MINS, np.uint64, endpoint=False)


def shingles(text: str | None, hashes: WordHashes, shingle: int = SHINGLE) -> np.ndarray:
    """The set of shingles as sorted 64-bit hashes."""
    words = hashes.of(lower_words(text))
    if not len(words):
        return np.empty(0, np.uint64)
    n = min(shingle, len(words))
    found = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        found = (found ^ words[k : len(words) - n + 1 + k]) * _MIX
        found ^= found >> np.uint64(29)
    return np.unique(found)


def similar(a: np.ndarray, b: np.ndarray, least: Fraction = SIMILAR) -> bool:
    """Whether two sets have a Jaccard similarity of ``least`` at least; two empty ones have."""
    most, few = max(len(a), len(b)), min(len(a), len(b))
    if few * least.denominator < most * least.numerator:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least.denominator >= (len(a) + len(b) - both) * least.numerator


# -- fingerprints and sketches -------------------------------------------------------------------


def fingerprints_and_sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and sketch (a row of bytes) of each of some sets, none empty."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0, *(len(s) for s in sets[:-1])])
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
    sizes = np.array([len(s) for s in sets])
    prints = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    mins = np.empty((len(sets), MINS), np.uint8)
    for i in range(MINS):
        mins[:, i] = (np.minimum.reduceat(flat * _FACTORS[i] + _ADDED[i], begins) * _MIX) >> np.uint64(56)
    return prints, mins


def sketches(mins: np.ndarray) -> np.ndarray:
    """One bit of each min-hash, 64 in a number."""
    return np.packbits(mins & 1, axis=1, bitorder="little").view(np.uint64).ravel()


def bits_apart(least: Fraction = SIMILAR, lost: float = LOST) -> int:
    """Bits in which sketches of a pair at the threshold differ at most, but for a share ``lost`` of such pairs."""
    differ = (1 - float(least)) / 2
    most, rest = MINS, 0.0
    while most and rest + (chance := math.comb(MINS, most) * differ**most * (1 - differ) ** (MINS - most)) <= lost:
        most, rest = most - 1, rest + chance
    return most


def prints(ranked: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row (rank, text): rank, key (equal for equal sets), fp, sketch and mins."""

    def lot(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        fp, sketch, mins = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64), [b""] * len(sets)
        full = [i for i, s in enumerate(sets) if len(s)]
        if full:
            found, rows = fingerprints_and_sketches([sets[i] for i in full])
            fp[full], sketch[full] = found, sketches(rows)
            for i, row in zip(full, rows, strict=True):
                mins[i] = row.tobytes()
        return fp, sketch, mins

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for given in batches:
            begin, sets, held = 0, [], 0
            for i, text in enumerate(given.column(1).to_pylist()):
                sets.append(shingles(text, hashes, shingle))
                held += len(sets[-1])
                if held >= PART or i == given.num_rows - 1:
                    fp, sketch, mins = lot(sets)
                    keys = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                    longs = (pa.array(x.view(np.int64)) for x in (keys, fp, sketch))
                    columns = [given.column(0).slice(begin, len(sets)), *longs, pa.array(mins, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["rank", "key", "fp", "sketch", "mins"])
                    begin, sets, held = i + 1, [], 0

    return ranked.select("rank", "text").mapInArrow(read, f"rank {ranked.schema['rank'].dataType.simpleString()}, key long, fp long, sketch long, mins binary")


# -- candidates ----------------------------------------------------------------------------------


def expected_recall(bits: int, n_masks: int, distance: int = DISTANCE, least: Fraction = SIMILAR) -> float:
    """The probability that fingerprints of two sets at the threshold meet under some random mask, at most ``distance`` apart."""
    cosine = 2 * float(least) / (1 + float(least))
    differ = math.acos(cosine) / math.pi
    total = 0.0
    for d in range(distance + 1):
        meet = math.comb(64 - d, bits) / math.comb(64, bits)
        total += math.comb(64, d) * differ**d * (1 - differ) ** (64 - d) * (1 - (1 - meet) ** n_masks)
    return total


def candidate_masks(n: int, recall: float = RECALL, distance: int = DISTANCE, least: Fraction = SIMILAR) -> list[int]:
    """Random masks for ``n`` texts, the same ones each time."""
    bits, n_masks = min(MOST_BITS, max(BITS, int(math.log2(max(n, 2))) - CROWD)), 8
    while expected_recall(bits, n_masks, distance, least) < recall and n_masks < 4096:
        n_masks += 4
    rng = np.random.default_rng(6)
    return [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(n_masks)]


def _longs(column: pa.Array, kind: type = np.int64) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _apart(x: np.ndarray, y: np.ndarray, sketch: np.ndarray, sketch_2: np.ndarray, most: int) -> np.ndarray:
    """Bits in which fingerprints differ, and ``_FAR`` where sketches differ in more than ``most``."""
    apart = np.bitwise_count(x[:, None] ^ y[None, :])
    apart[np.bitwise_count(sketch[:, None] ^ sketch_2[None, :]) > most] = _FAR
    return apart


def nearest_candidates(keys: DataFrame, on: list[int], distance: int = DISTANCE, most: int = bits_apart()) -> DataFrame:
    """Each key that has candidates: the nearest one, the least one, and how often candidates were met; keys are (key, fp, sketch)."""
    nodes = stored(lower_nodes(keys, distance, on=on, extra=("key", "sketch")), "jaccard-nodes")
    schema = pa.schema([("key", pa.int64()), ("d", pa.int32()), ("partner", pa.int64()), ("least", pa.int64()), ("degree", pa.int64())])
    last = np.iinfo(np.int64).max

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            found: list[tuple[np.ndarray, ...]] = []
            same = (given.column(0).to_numpy() == given.column(1).to_numpy()).tolist()
            packed = (_longs(given.column(i), t) for i, t in enumerate((np.uint64,) * 2 + (np.int64,) * 2 + (np.uint64,) * 2, 2))
            for alike, x, y, kx, ky, sx, sy in zip(same, *packed, strict=True):
                if alike and len(x) == 1:
                    continue
                apart = _apart(x, y, sx, sy, most)
                if alike:
                    np.fill_diagonal(apart, _FAR)
                for own, other, far in ((kx, ky, apart), *(() if alike else ((ky, kx, apart.T),))):
                    at = far.argmin(axis=1)
                    d = far[np.arange(len(own)), at]
                    use = np.flatnonzero(d <= distance)
                    if len(use):
                        near = far[use] <= distance
                        least = np.where(near, other[None, :], last).min(axis=1)
                        found.append((own[use], d[use], other[at[use]], least, near.sum(axis=1)))
            if found:
                key, d, partner, least, degree = (np.concatenate(x) for x in zip(*found, strict=True))
                yield batch(schema, key=key, d=d.astype(np.int32), partner=partner, least=least, degree=degree)

    columns = ["fps", "keys", "sketchs"]
    pairs = node_pairs(nodes, distance, columns).select("node", "node_2", *(f"{c}{end}" for c in columns for end in ("", "_2")))
    near = pairs.mapInArrow(compare, "key long, d int, partner long, least long, degree long")
    best = near.groupBy("key").agg(F.min(F.struct("d", "partner")).alias("best"), F.min("least").alias("least"), F.sum("degree").alias("degree"))
    return best.select("key", F.col("best.partner").alias("nearest"), "least", "degree")


def hub_candidates(keys: DataFrame, on: list[int], distance: int = DISTANCE, most: int = bits_apart()) -> DataFrame:
    """Each key's candidate of the greatest degree: key, hub; keys are (key, fp, sketch, degree)."""
    nodes = stored(lower_nodes(keys, distance, on=on, extra=("key", "degree", "sketch")), "jaccard-nodes")
    schema = pa.schema([("key", pa.int64()), ("degree", pa.int64()), ("hub", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            found: list[tuple[np.ndarray, ...]] = []
            same = (given.column(0).to_numpy() == given.column(1).to_numpy()).tolist()
            packed = (_longs(given.column(i), t) for i, t in enumerate((np.uint64,) * 2 + (np.int64,) * 4 + (np.uint64,) * 2, 2))
            for alike, x, y, kx, ky, gx, gy, sx, sy in zip(same, *packed, strict=True):
                near = _apart(x, y, sx, sy, most) <= distance
                if alike:
                    np.fill_diagonal(near, False)
                for own, other, degree, met in ((kx, ky, gy, near), *(() if alike else ((ky, kx, gx, near.T),))):
                    some = np.where(met, degree[None, :], -1)
                    at = some.argmax(axis=1)
                    greatest = some[np.arange(len(own)), at]
                    use = greatest >= 0
                    if use.any():
                        found.append((own[use], greatest[use], other[at[use]]))
            if found:
                key, degree, hub = (np.concatenate(x) for x in zip(*found, strict=True))
                yield batch(schema, key=key, degree=degree, hub=hub)

    columns = ["fps", "keys", "degrees", "sketchs"]
    pairs = node_pairs(nodes, distance, columns).select("node", "node_2", *(f"{c}{end}" for c in columns for end in ("", "_2")))
    met = pairs.mapInArrow(compare, "key long, degree long, hub long")
    return met.groupBy("key").agg(F.max(F.struct("degree", "hub")).alias("best")).select("key", "best.hub")


def next_candidates(keys: DataFrame, on: list[int], distance: int = DISTANCE, partners: int = PARTNERS, most: int = bits_apart()) -> DataFrame:
    """Pairs (a, b), a > b, that aren't linked: for each a the next ``partners`` after its cursor, the nearest first.

    Keys are (key, fp, sketch, root, d, last): a key's cursor is the distance and key of the candidate checked last.
    """
    nodes = stored(lower_nodes(keys, distance, on=on, extra=("key", "root", "d", "last", "sketch")), "jaccard-nodes")
    columns = ["fps", "keys", "roots", "ds", "lasts", "sketchs"]
    schema = pa.schema([("a", pa.int64()), ("d", pa.int64()), ("b", pa.int64())])

    def open_pairs(alike: bool, one: list[np.ndarray], two: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        apart = _apart(*(x[k].view(np.uint64) for k in (0, 5) for x in (one, two)), most)
        i, j = np.nonzero((apart <= distance) & (one[2][:, None] != two[2][None, :]))
        if alike:
            i, j = i[i < j], j[i < j]
        d, x, y = apart[i, j].astype(np.int64), one[1][i], two[1][j]
        first = x > y
        a, b = np.where(first, x, y), np.where(first, y, x)
        seen, last = np.where(first, one[3][i], two[3][j]), np.where(first, one[4][i], two[4][j])
        use = (d > seen) | ((d == seen) & (b > last))
        a, d, b = a[use], d[use], b[use]
        order = np.lexsort((b, d, a))
        a, d, b = a[order], d[order], b[order]
        begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
        use = np.arange(len(a)) - np.repeat(begin, np.diff(np.r_[begin, len(a)])) < partners
        return a[use], d[use], b[use]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            same = (given.column(0).to_numpy() == given.column(1).to_numpy()).tolist()
            packed = [_longs(c) for c in given.columns[2:]]
            found = [open_pairs(same[i], [p[i] for p in packed[:6]], [p[i] for p in packed[6:]]) for i in range(given.num_rows)]
            if found:
                a, d, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield batch(schema, a=a, d=d, b=b)

    pairs = node_pairs(nodes, distance, columns).select("node", "node_2", *columns, *(f"{c}_2" for c in columns))
    found = pairs.mapInArrow(compare, "a long, d long, b long").distinct()
    place = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return found.withColumn("place", place).filter(F.col("place") <= partners).select("a", "d", "b")


# -- links ---------------------------------------------------------------------------------------


def packed_texts(texts: DataFrame) -> DataFrame:
    """key, and its text's bytes, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for given in batches:
            some = [raw(t) for t in given.column(1).to_pylist()]
            data = pa.array([codec.compress(t, asbytes=True) if t else b"" for t in some], pa.binary())
            yield pa.RecordBatch.from_arrays([given.column(0), data, pa.array(map(len, some), pa.int64())], names=[given.schema.names[0], "data", "n"])

    return texts.mapInArrow(pack, f"`{texts.columns[0]}` long, data binary, n long")


def verified(pairs: DataFrame, hashed: DataFrame, texts: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar; ``hashed`` is (key, mins), texts (key, data, n)."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            x, y = (np.frombuffer(b"".join(given.column(i).to_pylist()), np.uint8).reshape(given.num_rows, MINS) for i in (2, 3))
            use = (x == y).sum(axis=1) >= LIKELY * MINS
            yield pa.RecordBatch.from_arrays([given.column(0), given.column(1)], names=["a", "b"]).filter(pa.array(use, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, codec = WordHashes(), pa.Codec("zstd", 1)

        def shingled(data: bytes, n: int) -> np.ndarray:
            return shingles(codec.decompress(data, n, asbytes=True).decode("utf-8", "surrogatepass") if n else "", hashes, shingle)

        for given in batches:
            sides = (zip(given.column(i).to_pylist(), given.column(i + 1).to_pylist(), strict=True) for i in (2, 4))
            use = [similar(shingled(*x), shingled(*y), least) for x, y in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([given.column(0), given.column(1)], names=["a", "b"]).filter(pa.array(use, pa.bool_()))

    full = hashed.filter(F.length("mins") > 0)
    left, right = (full.select(F.col("key").alias(k), F.col("mins").alias(f"mins_{k}")) for k in "ab")
    close = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "mins_a", "mins_b").mapInArrow(likely, "a long, b long"), "jaccard-likely")
    left, right = (texts.select(F.col("key").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("data", "n"))) for k in "ab")
    both = close.join(left, "a").join(right, "b").select("a", "b", "data_a", "n_a", "data_b", "n_b")
    return both.mapInArrow(compare, "a long, b long")


def linked(distinct: DataFrame, texts_of, shingle: int = SHINGLE, least: Fraction = SIMILAR, partners: int = PARTNERS, recall: float = RECALL) -> DataFrame:
    """Edges (a, b) with the components of all similar candidates among distinct keys (columns key, fp, sketch, mins).

    ``texts_of`` gives (key, data, n) for a table of keys.
    """
    on = candidate_masks(distinct.count(), recall, DISTANCE, least)
    most = bits_apart(least)
    nearest = stored(nearest_candidates(distinct.select("key", "fp", "sketch"), on, DISTANCE, most), "jaccard-nearest")
    texts = stored(texts_of(nearest.select("key")), "jaccard-texts")
    open_keys = stored(nearest.select("key", "degree").join(distinct.select("key", "fp", "sketch"), "key"), "jaccard-open")
    first = nearest.join(hub_candidates(open_keys, on, DISTANCE, most), "key", "left")
    both = first.select("key", F.explode(F.array("nearest", "least", F.coalesce("hub", "nearest"))).alias("partner"))
    pairs = both.select(F.greatest("key", "partner").alias("a"), F.least("key", "partner").alias("b")).distinct()
    edges = stored(verified(pairs, distinct, texts, shingle, least), "jaccard-links")
    cursors = None
    while True:
        roots = components(edges)
        keys = open_keys.join(roots, F.col("key") == F.col("node"), "left").select("key", "fp", "sketch", F.coalesce("root", "key").alias("root"))
        if cursors is None:
            keys = keys.withColumns({"d": F.lit(-1).cast("long"), "last": F.lit(0).cast("long")})
        else:
            moved = cursors.select(F.col("a").alias("key"), F.col("at.d").alias("d"), F.col("at.b").alias("last"))
            keys = keys.join(moved, "key", "left").withColumns({"d": F.coalesce("d", F.lit(-1)), "last": F.coalesce("last", F.lit(0))})
        pairs = stored(next_candidates(stored(keys, "jaccard-open"), on, DISTANCE, partners, most), "jaccard-pairs")
        per_key = pairs.groupBy("a").agg(F.max(F.struct("d", "b")).alias("at"), F.count("*").alias("n"))
        state = per_key.agg(F.count("*").alias("keys"), F.max("n").alias("most")).first()
        if not state["keys"]:
            return edges
        edges = stored(edges.union(verified(pairs.select("a", "b"), distinct, texts, shingle, least)), "jaccard-links")
        if state["most"] < partners:
            return edges
        fresh = per_key.select("a", "at")
        cursors = stored(fresh if cursors is None else cursors.join(fresh, "a", "left_anti").union(fresh), "jaccard-cursors")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: Fraction = SIMILAR, partners: int = PARTNERS) -> DataFrame:
    """The rows of ``docs`` (a stored table) without all but the first of each class.

    The first has the least id (null ids last); of rows with equal ids, the one that comes first in the table.
    """
    placed = numbered(docs, _ROW)
    rank = F.struct(F.col(id_col).isNull().alias("lost"), F.col(id_col).alias("id"), F.col(_ROW).alias("row"))
    all_prints = stored(prints(placed.select(rank.alias("rank"), F.col(text_col).alias("text")), shingle), "jaccard-prints")
    distinct = stored(all_prints.groupBy("key").agg(F.min(F.struct("rank", "fp", "sketch", "mins")).alias("first")).select("key", "first.*"), "jaccard-distinct")

    def texts_of(keys: DataFrame) -> DataFrame:
        rows = distinct.join(keys, "key", "left_semi").select("key", F.col("rank.row").alias(_ROW))
        texts = packed_texts(placed.select(_ROW, F.col(text_col).alias("text")))
        return texts.join(rows, _ROW).select("key", "data", "n")

    found = components(linked(distinct, texts_of, shingle, least, partners))
    rooted = distinct.join(found, F.col("key") == F.col("node"), "left").select("key", "rank", F.coalesce("root", "key").alias("root"))
    rooted = stored(rooted, "jaccard-roots")
    firsts = rooted.groupBy("root").agg(F.min("rank").alias("first"))
    named = rooted.join(firsts, "root").select("key", F.col("first.row").alias("kept"))
    later = all_prints.select("rank", "key").join(named, "key").filter(F.col("rank.row") != F.col("kept"))
    gone = stored(later.select(F.col("rank.row").alias(_ROW)), "jaccard-later")
    return placed.join(gone, _ROW, "left_anti").select(*docs.columns)
