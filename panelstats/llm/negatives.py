"""Hard-negative mining: Strassen products of integer tiles, then mergeable heaps.

Vectors become integers.  Rows are dealt into tiles, anchors into tiles of their own; every pair of an anchor tile
and a group of candidate tiles is a cell, and a cell multiplies its tiles by Strassen's recursion on int64 blocks
(odd sides are padded with zeros, sums are exact).  A first round keeps, per anchor, a heap of its best rows of the
same label: the positives.  A second one keeps, per anchor and positive, a heap of the best rows of other labels
within a window under the positive's score.  Heaps of cells are merged by key, at most 256 of them at a time.

A cell holds one anchor tile and a few candidate tiles, whatever the size of the table.  Tiles, not rows, are what
cells copy: an anchor tile travels once per candidate group, a candidate tile once per anchor tile.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite component take no
part; shorter vectors count as padded with zeros; rows that repeat an id count once if their scores do, and are
rows of their own otherwise; of anchors with equal ids the one with the least label and vector is used, and no row
of its id is one of its positives; an anchor without positives has no rows, nor has a positive with a negative
score; an empty table gives an empty result.  Components so large that a score might leave 64 bits raise an error.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstats.shared import stored

from .heaps import Heaps, merged
from .strassen import multiply
from .text import batch

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A window under a positive's score p: low * p <= 100 * score <= 100 * p.
LOW = 80
#: Rows of an anchor tile, of a candidate tile, and candidate rows of a cell about.
ANCHORS, CANDIDATES, CELL = 1024, 2048, 4096
_MIN = np.iinfo(np.int64).min
_TILE = "part long, width int, ids binary, labels binary, numbers binary"
_PARTS = ["width", "ids", "labels", "numbers"]
Tile = tuple[np.ndarray, np.ndarray, np.ndarray]


def integer_rows(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int = SCALE, label: Column | None = None) -> DataFrame:
    """id, label and numbers (floor(scale * x) of each component) of the rows that take part."""
    usable = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & usable)
    numbers = F.transform(vector_col, lambda x: F.floor(F.lit(scale).cast("double") * x.cast("double")))
    label = F.col(label_col) if label is None else label
    return kept.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), numbers.alias("numbers"))


def _most(numbers: np.ndarray) -> int:
    return max(int(numbers.max(initial=0)), -int(numbers.min(initial=0)))


def _packed(ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """A tile's columns, rows sorted by label and id, in the shortest integers that hold them."""
    order = np.lexsort((ids, labels))
    most = _most(numbers)
    kind = next(k for k in (np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
    return numbers.shape[1], ids[order].tobytes(), labels[order].tobytes(), numbers[order].astype(kind).tobytes()


def _unpacked(width: int, ids: bytes, labels: bytes, numbers: bytes) -> Tile:
    ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
    kind = {2: np.int16, 4: np.int32}.get(len(numbers) // max(1, len(ids) * width), np.int64)
    return ids, labels, np.frombuffer(numbers, kind).reshape(len(ids), width).astype(np.int64)


def tiles(rows: DataFrame, size: int) -> DataFrame:
    """The rows (id, label, numbers) of each task in tiles of at most ``size`` rows."""
    schema = pa.schema([("part", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("numbers", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []

        def tile() -> pa.RecordBatch:
            nonlocal made
            ids, labels = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            lists = [v for h in held for v in h[2]]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            numbers = np.zeros((len(lists), max(1, int(lengths.max(initial=0)))), np.int64)
            numbers[np.arange(numbers.shape[1]) < lengths[:, None]] = np.concatenate(lists)
            width, *packed = _packed(ids, labels, numbers)
            made += 1
            return batch(schema, part=[made], width=[width], **{n: [v] for n, v in zip(("ids", "labels", "numbers"), packed, strict=True)})

        for given in batches:
            for at in range(0, given.num_rows, size):
                some = given.slice(at, size)
                flat, ends = some.column(2).flatten().to_numpy(), np.asarray(some.column(2).offsets)[1:-1]
                vectors = np.split(flat, ends - some.column(2).offsets[0].as_py())
                ids, labels = some.column(0).to_numpy(), some.column(1).to_numpy()
                while len(ids):
                    room = size - sum(len(h[0]) for h in held)
                    held.append((ids[:room], labels[:room], vectors[:room]))
                    ids, labels, vectors = ids[room:], labels[room:], vectors[room:]
                    if sum(len(h[0]) for h in held) == size:
                        yield tile()
                        held = []
        if held:
            yield tile()

    return rows.select("id", "label", "numbers").mapInArrow(cut, _TILE)


def _products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of anchors and candidates; raises where one might not fit 64 bits with room for the window."""
    width = max(a.shape[1], c.shape[1])
    if width * _most(a) * _most(c) * 100 >= 1 << 63:
        raise ValueError("components are too large for scores of 64 bits")
    return multiply(_widened(a, width), _widened(c, width).T)


def _widened(numbers: np.ndarray, width: int) -> np.ndarray:
    return np.pad(numbers, ((0, 0), (0, width - numbers.shape[1]))) if numbers.shape[1] < width else numbers


def _distinct(ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray) -> Tile:
    """The rows of a tile without plain repeats."""
    if len(np.unique(ids)) == len(ids):
        return ids, labels, numbers
    keep = np.sort(np.unique(np.c_[ids, labels, numbers], axis=0, return_index=True)[1])
    return ids[keep], labels[keep], numbers[keep]


def _offer(heaps: Heaps, keys: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
    """Push the fitting entries of a block of scores (a row for each key) that may be among the best."""
    fits &= scores >= heaps.least[keys][:, None]
    n, k = scores.shape[1], heaps.k
    if n > k and len(np.unique(ids)) == n:  # equal ids may collapse, and then more than k are needed
        kth = np.partition(np.where(fits, scores, _MIN), n - k, axis=1)[:, n - k]
        fits &= scores >= kth[:, None]
    i, j = np.nonzero(fits)
    heaps.push(keys[i], scores[i, j], ids[j])


def _cells(anchors: DataFrame, candidates: DataFrame, n_anchors: int, n_groups: int, work: Callable, kinds: str) -> DataFrame:
    """``work(anchor tile, candidate tiles, group)`` for every anchor tile and every group of candidate tiles."""
    of_task = F.shiftright("part", 32)
    left = anchors.withColumn("a", F.pmod(of_task, F.lit(n_anchors)).cast("int"))
    left = left.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).drop("part")
    right = candidates.withColumn("g", F.pmod(F.xxhash64("part"), F.lit(n_groups)).cast("int"))
    right = right.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)))).drop("part")

    def cell(key: tuple, mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or others.empty:
            return pd.DataFrame({f.split()[0]: pd.Series(dtype="int64") for f in kinds.split(", ")})
        some = [_unpacked(*row) for row in mine[_PARTS].itertuples(index=False)]
        width = max(numbers.shape[1] for _, _, numbers in some)
        ids, labels = (np.concatenate([tile[i] for tile in some]) for i in (0, 1))
        numbers = np.concatenate([_widened(n, width) for _, _, n in some])
        tiles = (_distinct(*_unpacked(*row)) for row in others[_PARTS].itertuples(index=False))
        return work((ids, labels, numbers), tiles, int(key[1]))

    return left.groupBy("a", "g").cogroup(right.groupBy("a", "g")).applyInPandas(cell, kinds)


def mine_negatives(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    scale: int = SCALE,
    sizes: tuple[int, int, int] = (ANCHORS, CANDIDATES, CELL),
) -> DataFrame:
    """Per anchor and positive, the first ``negatives`` rows of other labels in the window: the contract's columns.

    ``anchor`` chooses the anchors among the rows by ``id``; ``label`` is the label's value where it isn't the
    column's own.
    """
    whole = integer_rows(rows, id_col, label_col, vector_col, scale, label)
    candidates = stored(tiles(whole, sizes[1]), "negatives-tiles")
    n_rows = candidates.agg(F.sum(F.octet_length("ids") / 8)).first()[0] or 0
    n_groups = max(1, int(-(-n_rows // sizes[2])))
    first = F.min(F.struct("label", "numbers")).alias("one")
    chosen = stored(whole.filter(anchor).groupBy("id").agg(first).select("id", "one.*"), "negatives-anchors")
    n_chosen = chosen.count()
    spread = max(1, -(-n_chosen // sizes[0]))

    def nearest(mine: Tile, others: Iterator[Tile], group: int) -> pd.DataFrame:
        ids, labels, numbers = mine
        heaps = Heaps(len(ids), positives)
        for c_ids, c_labels, c_numbers in others:
            for own in np.intersect1d(labels, c_labels):
                a, c = np.flatnonzero(labels == own), np.flatnonzero(c_labels == own)
                scores = _products(numbers[a], c_numbers[c])
                _offer(heaps, a, scores, ids[a][:, None] != c_ids[c][None, :], c_ids[c])
        return pd.DataFrame({"anchor_id": ids[heaps.key], "positive_score": heaps.score, "positive_id": heaps.id, "part": group})

    kinds = "anchor_id long, positive_score long, positive_id long, part long"
    a_tiles = stored(tiles(chosen.repartition(spread, "id"), sizes[0]), "negatives-anchor-tiles")
    found = _cells(a_tiles, candidates, spread, n_groups, nearest, kinds)
    by_score = [F.col("positive_score").desc(), F.col("positive_id")]
    near = stored(merged(found, ["anchor_id"], by_score, positives, "part", n_groups), "negatives-positives")

    windows = near.filter("positive_score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("tops"))
    windowed = chosen.join(windows, F.col("id") == F.col("anchor_id")).select("id", "label", F.concat("tops", F.array_repeat(F.lit(-1).cast("long"), F.lit(positives) - F.size("tops")), "numbers").alias("numbers"))
    w_tiles = stored(tiles(windowed.repartition(spread, "id"), sizes[0]), "negatives-windows")

    def hardest(mine: Tile, others: Iterator[Tile], group: int) -> pd.DataFrame:
        ids, labels, joint = mine
        tops, numbers = joint[:, :positives], joint[:, positives:]
        heaps = Heaps(len(ids) * positives, negatives)
        for c_ids, c_labels, c_numbers in others:
            scores = _products(numbers, c_numbers)
            apart = labels[:, None] != c_labels[None, :]
            for w in range(positives):
                use = np.flatnonzero(tops[:, w] >= 0)
                if len(use):
                    some, top = scores[use], tops[use, w][:, None]
                    fits = apart[use] & (some <= top) & (100 * some >= low * top)
                    _offer(heaps, use * positives + w, some, fits, c_ids)
        at, w = np.divmod(heaps.key, positives)
        return pd.DataFrame({"anchor_id": ids[at], "positive_score": tops[at, w], "negative_score": heaps.score, "negative_id": heaps.id, "part": group})

    kinds = "anchor_id long, positive_score long, negative_score long, negative_id long, part long"
    found = _cells(w_tiles, candidates, spread, n_groups, hardest, kinds)
    window = ["anchor_id", "positive_score"]
    by_score = [F.col("negative_score").desc(), F.col("negative_id")]
    hard = merged(found, window, by_score, negatives, "part", n_groups)
    place = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(*by_score))
    return near.join(hard, window).select("anchor_id", "positive_id", place.alias("rank"), "negative_id", "positive_score", "negative_score")


def contract_label(id_col: str = "vec_id", label_col: str = "label") -> Column:
    """The label the query mines with: the next of ten where the id is divisible by 7."""
    return F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col))


def negatives_sql() -> str:
    """The query's rows in SQL."""
    return """
        with given as (
          select distinct vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label,
                 [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] v
          from embeddings
          where vec_id is not null and label is not null and embedding is not null
            and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
        scored as materialized (
          select a.id anchor_id, c.id id, a.label = c.label alike,
                 cast(list_sum([p[1] * p[2] for p in list_zip(a.v, c.v)]) as bigint) score
          from given a, given c where a.id % 100 = 0),
        positives as (
          select anchor_id, id positive_id, score positive_score from scored where alike and id <> anchor_id
          qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
        negatives as (
          select p.*, s.id negative_id, s.score negative_score,
                 row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) "rank"
          from positives p join scored s on s.anchor_id = p.anchor_id and not alike
               and 80 * positive_score <= 100 * s.score and s.score <= positive_score)
        select anchor_id, positive_id, cast("rank" as integer) "rank", negative_id, positive_score, negative_score
        from negatives where "rank" <= 5
    """
